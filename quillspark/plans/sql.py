"""The same operators in DuckDB SQL, written from their definitions, for comparison."""

from __future__ import annotations

import re

from ..functions.packs import PUNCTUATION, Pack
from ..functions.segment import BEFORE, PIECES, Segmenter
from ..functions.thresholds import DESCRIPTIONS, RULE_DIMENSIONS, gap_sql, zone_sql
from ..operators.dimensions import CLASSICAL, HUMAN_SIGNS, NARRATIVE

SPACE = r"[ \t\r\n\x0B\f\x{00A0}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(own: list[str]) -> str:
    return "[" + ", ".join(map(q, own)) + "]" if own else "CAST([] AS VARCHAR[])"


def occurrences(text: str, own: list[str]) -> str:
    return f"coalesce(list_sum(list_transform({words(own)}, lambda p: (len({text}) - len(replace({text}, p, ''))) // len(p))), 0)"


def hits(text: str, own: list[str]) -> str:
    return f"len(list_filter({words(list(dict.fromkeys(own)))}, lambda p: contains({text}, p)))"


def paragraphs(pack: Pack, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""
par0 AS (SELECT {key} AS doc_id, list_filter(list_transform(string_split_regex({text}, {q(pack.paragraph)}), lambda x: {strip("x")}), lambda x: len(x) > {pack.least_paragraph}) AS parts FROM {table}),
par AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS p_idx, parts[i] AS text, CASE WHEN i > 1 THEN parts[i - 1] ELSE '' END AS prev
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM par0))"""


def turns() -> str:
    return """
par AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS p_idx, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations)"""


def sentence_list(text: str, pack: Pack) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, {q(pack.sentence)}), lambda x: {strip('x')}), lambda x: len(x) > {pack.least_sentence})"


def tokens(text: str, pack: Pack) -> str:
    if pack.cutter:
        return segmented(f"lower({text})", pack.cutter)
    return f"regexp_extract_all(lower({text}), {q(pack.token)})"


def _map(own: dict, value=str) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {value(v)}" for k, v in own.items()) + "}"


def segmented(text: str, cutter: Segmenter) -> str:
    """The words of a text as one expression: lists of costs, walked from the end of each run for its cut, and along each unknown stretch for the places of its signs."""
    let = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    known = _map(cutter.words, lambda c: f"{c}::BIGINT")
    # entry i of `best` is 16 * the cost from there to the end + 15 - the length of the word there, so the least one is the longest of the cheapest
    word = f"coalesce(({known})[substr(run, i, n)], CASE WHEN n = 1 THEN {cutter.alone} END)"
    best = f"list_reduce(range(len(run), 0, -1), lambda acc, i: list_prepend(list_min(list_transform(range(1, least({cutter.longest}, len(run) - i + 1) + 1), lambda n: ({word} + acc[n] // 16) * 16 + 15 - n)), acc), [15::BIGINT])"
    starts = "list_reduce(range(1, len(run) + 1), lambda acc, i: CASE WHEN acc[-1] = i THEN list_append(acc, i + 15 - best[i] % 16) ELSE acc END, [1::BIGINT])"
    # single signs next to each other are one stretch: a word begins where neither it nor the one before is a single sign
    single = "starts[{k} + 1] - starts[{k}] = 1"
    parts = f"list_append(list_filter(starts[:-2], lambda s, k: k = 1 OR NOT ({single.format(k='k')} AND {single.format(k='(k - 1)')})), starts[-1])"
    rows = ", ".join(f"{q(s)}: {list(e)}::BIGINT[]" for s, e in cutter.signs.items())
    own = lambda i: f"coalesce((MAP {{{rows}}})[substr(part, {i}, 1)], {cutter.unknown}::BIGINT[])"
    # four entries a sign, each 4 * the cost of the path to that place + the place before
    step = lambda p: "list_min([" + ", ".join(f"(acc[{b - 4}] // 4 + {cutter.move[b][p]}) * 4 + {b}" for b in BEFORE[p]) + f"]) + 4 * e[{p + 1}]"
    first = "[" + ", ".join(f"4 * ({cutter.start[p]} + e[{p + 1}])" for p in range(4)) + "]"
    paths = f"list_reduce(range(2, len(part) + 1), lambda acc, i: list_concat(acc, {let('e', own('i'), '[' + ', '.join(map(step, range(4))) + ']')}), {let('e', own('1'), first)})"
    last = "CASE WHEN paths[-2] // 4 <= paths[-1] // 4 THEN 2 ELSE 3 END::BIGINT"
    places = f"list_reduce(range(len(part), 1, -1), lambda acc, i: list_prepend(paths[4 * (i - 1) + acc[1] + 1] % 4, acc), [{last}])"
    ends = "list_filter(range(1, len(part) + 1), lambda i: places[i] >= 2)"
    cut = f"list_transform(ends, lambda e, k: substr(part, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END, e - CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END))"
    joined = let("paths", paths, let("places", places, let("ends", ends, cut)))
    # a stretch of single signs is one of which the cut has as many words as signs
    alone = "len(list_filter(starts, lambda s: s >= parts[j] AND s < parts[j + 1])) = len(part)"
    each = f"CASE WHEN len(part) = 1 OR NOT ({alone}) THEN [part] WHEN ({known})[part] IS NOT NULL THEN string_split(part, '') ELSE {joined} END"
    run = let("best", best, let("starts", starts, let("parts", parts, f"flatten(list_transform(range(1, len(parts)), lambda j: {let('part', 'substr(run, parts[j], parts[j + 1] - parts[j])', each)}))")))
    return f"flatten(list_transform(regexp_extract_all({text}, {q(PIECES)}), lambda run: CASE WHEN regexp_matches(run, '^[一-鿿]') THEN {run} ELSE [run] END))"


def similarity(pack: Pack) -> str:
    """sim(doc_id, p_idx, paragraph_similarity) from par."""
    return f"""
tf AS (SELECT doc_id, p_idx, t, sum(x) AS x, sum(y) AS y FROM (
         SELECT doc_id, p_idx, unnest({tokens("text", pack)}) AS t, 1 AS x, 0 AS y FROM par
         UNION ALL SELECT doc_id, p_idx, unnest({tokens("prev", pack)}), 0, 1 FROM par) GROUP BY ALL),
cut AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE 1 + ln(1.5::DOUBLE) END AS w FROM tf
        QUALIFY row_number() OVER (PARTITION BY doc_id, p_idx ORDER BY x + y DESC, t) <= 100),
sim AS (SELECT par.doc_id, par.p_idx, coalesce(CASE WHEN s.xx > 0 AND s.yy > 0 THEN s.xy / sqrt(s.xx * s.yy) END, 0.0::DOUBLE) AS paragraph_similarity
        FROM par LEFT JOIN (SELECT doc_id, p_idx, sum(x * y * w * w) AS xy, sum(x * x * w * w) AS xx, sum(y * y * w * w) AS yy FROM cut GROUP BY ALL) s USING (doc_id, p_idx))"""


def dims(pack: Pack, compare: bool = True) -> str:
    """dims(doc_id, p_idx, text, twelve values) from par."""
    signs = "[^" + re.sub(r"([\[\]\\^-])", r"\\\1", PUNCTUATION) + "]"
    n, bare = "len(text)", "replace(replace(text, ' ', ''), chr(10), '')"
    ratio = lambda a, b, k: f"CASE WHEN {b} > 0 THEN {a} * {k}::DOUBLE / {b} ELSE 0.0::DOUBLE END"
    counted = lambda x: f"map_values(list_aggregate({x}, 'histogram'))"
    gram = lambda k: f"list_transform(range(1, len(lg) - {k - 2}), lambda i: array_to_string(list_slice(lg, i, i + {k - 1}), chr(1)))"
    again = lambda k: f"CASE WHEN len(lg) >= {k + 2} THEN len(list_filter({counted(f'g{k}')}, lambda c: c > 1))::DOUBLE / len(g{k}) ELSE 0.0::DOUBLE END"
    sim = similarity(pack) + "," if compare else "\nsim AS (SELECT doc_id, p_idx, 0.0::DOUBLE AS paragraph_similarity FROM par),"
    return f"""{sim}
base AS (SELECT doc_id, p_idx, text, {sentence_list("text", pack)} AS ss, {tokens("text", pack)} AS tk, string_split({bare}, '') AS ch,
                string_split(regexp_replace(text, {q(signs)}, '', 'g'), '') AS sg FROM par),
base2 AS (SELECT *, list_filter(tk, lambda t: len(t) >= 2) AS lg FROM base),
base3 AS (SELECT *, {gram(2)} AS g2, {gram(3)} AS g3 FROM base2),
fq AS (SELECT doc_id, p_idx, t, count(*) AS f FROM (SELECT doc_id, p_idx, unnest(lg) AS t FROM base2) GROUP BY ALL),
rk AS (SELECT doc_id, p_idx, f, row_number() OVER (PARTITION BY doc_id, p_idx ORDER BY f DESC) AS r FROM fq),
zf AS (SELECT doc_id, p_idx, CASE WHEN sum(f) >= 20 AND count(*) >= 3 AND max(f) > min(f) THEN 1 - regr_r2(ln(f), ln(r)) ELSE 0.0::DOUBLE END AS z FROM rk GROUP BY ALL),
dims AS (SELECT b.doc_id, b.p_idx, b.text,
  CASE WHEN len(ss) >= 3 THEN list_aggregate(list_transform(ss, lambda s: len(s)), 'stddev_pop') ELSE 0.0::DOUBLE END AS sentence_length_std,
  {ratio(occurrences("text", pack.all_connectors), n, 1000)} AS connector_density,
  {ratio(f"len(list_filter(lg, lambda t: NOT list_contains({words(pack.stopwords)}, t) AND NOT regexp_matches(t, '^[0-9]+$')))", "len(tk)", 1)} AS info_density,
  {ratio(f"len(list_filter(tk, lambda t: regexp_matches(t, {q(pack.term)}) AND NOT list_contains({words(pack.stopwords)}, t)))", f"len({bare})", 100)} AS term_density,
  sim.paragraph_similarity,
  {ratio(f"len(list_filter({counted('lg')}, lambda c: c = 1))", "len(lg)", 1)} AS hapax_ratio,
  coalesce(zf.z, 0.0::DOUBLE) AS zipf_deviation,
  {again(2)} AS bigram_repetition,
  {again(3)} AS trigram_repetition,
  CASE WHEN len(regexp_replace(text, {q(signs)}, '', 'g')) > 0 THEN list_aggregate(sg, 'entropy') ELSE 0.0::DOUBLE END AS punctuation_entropy,
  CASE WHEN len({bare}) > 0 THEN list_aggregate(ch, 'entropy') ELSE 0.0::DOUBLE END AS overall_entropy,
  {ratio(occurrences("text", pack.dense_slop), n, 1000)} AS slop_density
  FROM base3 b LEFT JOIN zf USING (doc_id, p_idx) JOIN sim USING (doc_id, p_idx))"""


def scanned(pack: Pack, compare: bool = True) -> str:
    """cls from par, with the guard where the pack has one."""
    own = f"{dims(pack, compare)}, {classified()}"
    return f"{own.replace('cls AS (', 'cls1 AS (', 1)}, {GUARD.replace('FROM cls)', 'FROM cls1)', 1)}, cls AS (SELECT * FROM grd)" if pack.guard else own


def classified() -> str:
    """cls from dims: zones, counts, comprehensive_score, level."""
    zones = ", ".join(f"{zone_sql(d[0], d)} AS zone_{d[0]}" for d in RULE_DIMENSIONS)
    count = lambda z: " + ".join(f"(CASE WHEN zone_{d[0]} = '{z}' THEN 1 ELSE 0 END)" for d in RULE_DIMENSIONS)
    weight = " + ".join(f"(CASE WHEN zone_{d[0]} = 'ai' THEN {float(d[3])!r}::DOUBLE ELSE 0.0::DOUBLE END)" for d in RULE_DIMENSIONS)
    return f"""
zn AS (SELECT *, {zones} FROM dims),
cl0 AS (SELECT *, {count("ai")} AS ai_count, {count("gray")} AS gray_count, {count("human")} AS human_count, ({weight}) / {sum(d[3] for d in RULE_DIMENSIONS)!r}::DOUBLE AS comprehensive_score FROM zn),
cls AS (SELECT *, CASE WHEN ai_count >= 5 THEN 'deep_red' WHEN ai_count >= 3 THEN 'red' WHEN ai_count >= 2 THEN 'yellow' ELSE 'green' END AS level FROM cl0)"""


def unpivoted() -> str:
    """lng from dims."""
    each = " UNION ALL ".join(f"SELECT doc_id, p_idx, '{d[0]}' AS dim, {k} AS dim_ord, round({d[0]}, 4) AS value, {zone_sql(d[0], d)} AS zone, round({gap_sql(d[0], d)}, 4) AS gap, {q(DESCRIPTIONS[d[0]])} AS description, {float(d[3])!r}::DOUBLE AS weight FROM dims" for k, d in enumerate(RULE_DIMENSIONS))
    return f"\nlng AS ({each})"


_COMMAS = "(len(text) - len(replace(replace(text, '，', ''), ',', '')))"
HUMAN = " + ".join(
    [f"(CASE WHEN regexp_matches(text, {q(p)}) THEN {n} ELSE 0 END)" for p, n, _ in HUMAN_SIGNS]
    + [f"(CASE WHEN {_COMMAS} > 0 AND len(replace(replace(text, ' ', ''), chr(10), ''))::DOUBLE / greatest({_COMMAS}, 1) < 20 THEN 1 ELSE 0 END)", f"(CASE WHEN len(regexp_extract_all(text, {q(NARRATIVE)})) >= 3 THEN 2 ELSE 0 END)"]
)
_SIGNS = [(f"regexp_matches(text, {q(p)})", name) for p, _, name in HUMAN_SIGNS]
_SIGNS[-1:] = [(f"{_COMMAS} > 0 AND len(replace(replace(text, ' ', ''), chr(10), ''))::DOUBLE / greatest({_COMMAS}, 1) < 20", "短句节奏"), (f"len(regexp_extract_all(text, {q(NARRATIVE)})) >= 3", "散文叙事"), _SIGNS[-1]]
MARKS = "'[' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {there} THEN {q(chr(39) + name + chr(39))} END" for there, name in _SIGNS) + "], lambda x: x IS NOT NULL), ', ') || ']'"
GUARD = f"""
hm AS (SELECT *, {HUMAN} AS human_score, {MARKS} AS marks FROM cls),
hc AS (SELECT *, (human_score >= 4 AND regexp_matches(text, {q(CLASSICAL)})) OR human_score >= 5 AS is_classical FROM hm),
gd AS (SELECT *, CASE WHEN is_classical AND level <> 'green' THEN 1 WHEN human_score >= 4 AND level <> 'green' THEN 2 WHEN human_score >= 3 AND level IN ('red', 'deep_red') THEN 3
                      WHEN human_score >= 2 AND level = 'deep_red' THEN 4 ELSE 0 END AS rule FROM hc),
grd AS (SELECT doc_id, p_idx, text, ai_count, gray_count, human_count, human_score, is_classical, rule > 0 AS guard_triggered, level AS original_level,
        CASE rule WHEN 1 THEN '检测到经典文学特征（排比/拟人/诗化语言），降级处理' WHEN 2 THEN '检测到' || marks || '等强人类写作特征（≥4分）' WHEN 3 THEN '检测到' || marks || '等强人类写作特征' WHEN 4 THEN '检测到' || marks || '等人类写作特征' ELSE '' END AS guard_reason,
        CASE WHEN rule IN (1, 2) THEN CASE level WHEN 'deep_red' THEN 'red' WHEN 'red' THEN 'yellow' WHEN 'yellow' THEN 'green' ELSE level END WHEN rule = 3 THEN 'yellow' WHEN rule = 4 THEN 'red' ELSE level END AS level,
        comprehensive_score * CASE rule WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 3 THEN 0.7::DOUBLE WHEN 4 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS comprehensive_score FROM gd)"""
