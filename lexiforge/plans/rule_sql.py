"""SQL of the queries on punctuation rules, trees and chunks: texts are cut into words and the gaps in front of them."""

from __future__ import annotations

from lexiforge.operators import punctuation as P
from lexiforge.plans.shared import sql_list

_SWAPS = (("the", "который"), ("and", "потому что"), ("for", "однако"), ("les", "который"), ("und", "так как"))
_L = r"\p{L}\p{Nl}\p{No}"


def _russian() -> str:
    text = "text"
    for old, new in _SWAPS:
        # A boundary is one between any letters here; twice, as neighbours share the character between them.
        for _ in range(2):
            text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{Nd}}_]){old}($|[^\p{{L}}\p{{Nd}}_])', '\1{new}\2', 'g')"
    text = rf"regexp_replace({text}, '(?m)(^|\. )(Is|In|Le|Der) ', '\1Конечно ', 'g')"
    return f"select doc_id, translate({text}, 'abcdefghijklmnopqrstuvwxyz', 'абцдефгхийклмнопярстувшхыз') as text from documents"


#: w: words of a text by number, with the gap before and after each, and the places where a word starts and ends.
WORDS = rf"""ru as materialized ({_russian()}),
pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) - 1 as i from (select doc_id, regexp_extract_all(text, '[^{_L}]*[{_L}]+') as p from ru)),
placed as (select doc_id, i, regexp_extract(piece, '[{_L}]+$') as word, sum(length(piece)) over (partition by doc_id order by i)::BIGINT as e, piece from pieces),
w as materialized (select doc_id, i, word, lower(word) as low, e - length(word) as s, e, left(piece, length(piece) - length(word)) as gap from placed)"""

#: t: those words with sentences, a number in the sentence, and the head that follows from it.
TREES = rf"""{WORDS}, sents as (select *, sum(regexp_matches(gap, '[.!?]')::INT) over (partition by doc_id order by i)::BIGINT as sent_id from w),
t as materialized (select *, row_number() over (partition by doc_id, sent_id order by i) as no from sents)"""

_strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_slice = lambda s, e: f"substring(text, {s} + 1, {e} - ({s}))"


def _row(rule: str, subtype: str, fragment: str, description: str, suggestion: str, start: str = "s", around: str = "s") -> str:
    low, high = f"greatest(0, {around} - 50)", "least(length(text), e + 50)"
    context = f"(case when {around} > 50 then '…' else '' end) || {_strip(f'translate({_slice(low, high)}, chr(10), chr(32))')} || (case when e + 50 < length(text) then '…' else '' end)"
    return f"""select doc_id, '{P.TYPE}' as error_type, {subtype} as subtype, {fragment} as fragment, {description} as description, {suggestion} as suggestion,
    {start}::INT as start, e::INT as "end", 'PUNCT:{rule}' as rule_ref, 'PUNCT' as source, {context} as context"""


_ADVERSE = rf"""{_row("ADVERSE", "'Пропущена запятая перед «' || word || '»'", _strip(_slice("greatest(0, s - 15)", "e")), "'Перед союзом «' || word || '» в сложносочинённом предложении нужна запятая.'", "'Вставьте запятую перед «' || word || '»'")}
from (select a.doc_id, text, a.word, b.e as s, a.e from w a join w b on b.doc_id = a.doc_id and b.i = a.i - 1 left join w n on n.doc_id = a.doc_id and n.i = a.i + 1 join ru on ru.doc_id = a.doc_id
    where a.low in {sql_list(P.ADVERSATIVE)} and regexp_matches(a.gap, '^\s+$') and a.gap[1] <> chr(10) and regexp_matches(b.low, '[а-яё]$') and not regexp_matches(coalesce(n.gap, ''), '^[\d_]'))"""

#: ph: a label of several words, found at each place where its words follow each other.
_glue = r"case when regexp_matches(gap, '^\s+$') then ' ' else gap end"


def _phrases(labels: tuple[str, ...]) -> str:
    most = max(label.count(" ") + label.count("-") for label in labels) + 1
    ahead = " || ".join(f"coalesce(lead({_glue}, {k}) over o || lead(low, {k}) over o, '')" for k in range(1, most))
    ends = ", ".join(f"lead(e, {k}) over o" for k in range(1, most))
    return rf"""labels as (select unnest({list(labels)}) as label),
    ahead as (select doc_id, i, s, gap, low || {ahead} as words, [e, {ends}] as ends from w window o as (partition by doc_id order by i)),
    ph as (select a.doc_id, label, a.i, a.i + n - 1 as last, a.s, ends[n] as e, a.gap from (select label, len(regexp_extract_all(label, '[{_L}]+')) as n from labels) join ahead a on starts_with(words, label)
        where not regexp_matches(substring(words, length(label) + 1, 1), '[{_L}\d_]') and not regexp_matches(a.gap, '[\d_]$'))"""


_COMPOUND = rf"""{_row("COMPOUND", "'Пропущена запятая перед «' || label || '»'", _strip(_slice("greatest(0, s - 20)", "e")), "'Перед составным союзом «' || label || '» нужна запятая.'", "'Вставьте запятую перед «' || label || '»'")}
from ph join ru using (doc_id) where i > 0 and regexp_matches(gap, '^\s+$')"""

_found = _slice("s", "e")
_INTRO = rf"""{_row("INTRO", f"'Пропущена запятая после вводного слова «' || {_found} || '»'", f"{_found} || after || next", f"'После вводного слова «' || {_found} || '» нужна запятая.'", f"'Поставьте запятую после «' || {_found} || '»'")}
from (select ph.doc_id, text, label, ph.s, ph.e, n.gap as after, n.word[1] as next from ph join w n on n.doc_id = ph.doc_id and n.i = last + 1 join ru on ru.doc_id = ph.doc_id
    where (regexp_matches(ph.gap, '[.!?\n—]\s*$') or (ph.i = 0 and regexp_matches(ph.gap, '^\s*$'))) and regexp_matches(n.gap, '^\s+$') and regexp_matches(n.low, '^[а-яё]'))"""

_clause = rf"length(regexp_extract(left(text, stop), '(?s)^.*[,;.!?\n]'))"
_KOTORY = rf"""{_row("KOTORY", "'Пропущена запятая перед придаточным определительным'", "case when length(f) <= 50 then f else '…' || right(f, 48) end", "'Перед словом «' || word || '» нужна запятая: придаточное определительное отделяется запятой.'", "'Вставьте запятую перед «' || word || '»'", "start")}
from (select *, {_clause} as start, {_strip(_slice(_clause, "e"))} as f from (
    select a.doc_id, text, a.word, a.s, a.e, case when prep then c.e else b.e end as stop
    from (select *, lag(low) over (partition by doc_id order by i) in {sql_list(P.PREPOSITIONS)} as prep from w) a
    join w b on b.doc_id = a.doc_id and b.i = a.i - 1 left join w c on c.doc_id = a.doc_id and c.i = a.i - 2 join ru on ru.doc_id = a.doc_id
    where regexp_matches(a.low, '^котор({"|".join(P.RELATIVE_ENDINGS)})$') and regexp_matches(a.gap, '^\s+$') and (not prep or (a.i > 1 and regexp_matches(b.gap, '^\s+$')))))"""

_cut = "case when length(text) - low <= 500 then length(room) " + " ".join(
    f"when length(regexp_extract(room, '(?s)^.*{e}')) > 251 then length(regexp_extract(room, '(?s)^.*{e}'))" for e in (r"\.", "!", r"\?", r"\n")) + " else 500 end"
_CHUNKS = f"""walk as (select doc_id, coalesce(text, '') as text, 0::BIGINT as no, 0::BIGINT as low, left(coalesce(text, ''), 500) as room from documents
    union all select doc_id, text, no + 1, low + c, substring(text, low + c + 1, 500) from (select *, {_cut} as c from walk) where low + c < length(text)),
chunks as (select doc_id, no::INT as no, low::INT as "offset", left(room, {_cut}) as chunk from walk)"""

#: found: words of each content that a service answers on, with their ends; again: the one before is the same.
_ANSWERS = rf"""{_CHUNKS}, cp as (select chunk, unnest(p) as piece, generate_subscripts(p, 1) as i from (select distinct chunk, regexp_extract_all(chunk, '[^\p{{L}}]*\p{{L}}+') as p from chunks)),
cw as (select chunk, i, regexp_extract(piece, '\p{{L}}+$') as word, sum(length(piece)) over (partition by chunk order by i)::BIGINT as e from cp),
found as (select chunk, sha256(chunk) as chunk_key, word, length(word) as len, e, lower(word) = lag(lower(word)) over (partition by chunk order by i) as again from cw where left(sha256(chunk), 1) <> '0')"""

ORACLE = {
    "punct_adverse": f"with {WORDS} {_ADVERSE}",
    "punct_compound": f"with {WORDS}, {_phrases(P.COMPOUND)} {_COMPOUND}",
    "punct_intro": f"with {WORDS}, {_phrases(P.INTRODUCTORY)} {_INTRO}",
    "punct_kotory": f"with {WORDS} {_KOTORY}",
    "orc_sentence_groups": f"with {TREES} select doc_id, sent_id::INT as sent_id, count(*) as n, string_agg(word, ' ' order by i) as words from t group by doc_id, sent_id",
    "join_head": f"with {TREES} select a.doc_id, a.i::INT as tok_idx, a.word as text, b.word as head_text from t a join t b on b.doc_id = a.doc_id and b.sent_id = a.sent_id and b.no = a.no - 1 where a.no % 7 = 5",
    "join_subtree": f"with {TREES} select a.doc_id, a.sent_id::INT as sent_id, a.no::INT as token_id, b.no::INT as member from t a join t b on b.doc_id = a.doc_id and b.sent_id = a.sent_id and b.no >= a.no and (b.no - 1) // 7 = (a.no - 1) // 7",
    "prj_chunk": f"with recursive {_CHUNKS} select * from chunks",
    "orc_lt_http_check": f"with recursive {_ANSWERS} select doc_id, (\"offset\" + e - len)::INT as start, (\"offset\" + e)::INT as \"end\", word as fragment, '→ ' || word as suggestion from chunks join found using (chunk) where again",
    "src_ext_lt": f"with recursive {_ANSWERS} select chunk_key, 'REPEATED_WORD' as rule_id, (e - len)::INT as \"offset\", len::INT as length from found where again",
    "src_ext_speller": f"with recursive {_ANSWERS} select chunk_key, (e - len)::INT as pos, word from found where len >= 12",
    "orc_speller_check": f"with recursive {_ANSWERS} select doc_id, (\"offset\" + e - len)::INT as start, (\"offset\" + e)::INT as \"end\", word as fragment, '→ ' || lower(word) as suggestion from chunks join found using (chunk) where len >= 12",
}
TEXT_RULES = ORACLE["set_rule_union"] = " union all ".join(f"select * from ({ORACLE[f'punct_{rule}']})" for rule in P.TEXT_RULES)
