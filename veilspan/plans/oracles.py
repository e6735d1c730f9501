"""SQL for an independent engine that must give the same rows as each query.

The SQL takes other ways than the Spark code wherever it can: offsets by a running
sum over unnested matches, overlaps by windows, passwords by runs and boundaries.
"""

from __future__ import annotations

from veilspan.operators.report import CONFIRMED, NOTHING_FOUND
from veilspan.operators.verify import MIN_SCORE, SEED_VERDICTS
from veilspan.plans import derived
from veilspan.plans.catalogue import HEX_TOKEN, PAIR, STOP_WORD, TRIPLE
from veilspan.policy import DEFAULT_POLICY, Rule, mask_with
from veilspan.recognizers import DEFAULT_RECOGNIZERS, ENTITIES, SCORES

DOCUMENTS = "(select doc_id, text from documents)"
NOTES = f"(select c_custkey as doc_id, {derived.NOTE_TEXT} as text from customer)"

# This engine's \b knows ASCII only. A non-ASCII letter is replaced by a word too long
# and too odd for any pattern to match, and counted as one character.
FOREIGN = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]"
STAND_IN = "zq0_" * 11


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pattern(entity: str) -> str:
    (r,) = DEFAULT_RECOGNIZERS.only([entity])
    # Here '.' needs to be told to stop at the newline.
    return r.regex.replace(r"\s*.*", r"\s*[^\n]*")


def pattern_name(entity: str) -> str:
    (r,) = DEFAULT_RECOGNIZERS.only([entity])
    return r.pattern_name


def spans(source: str, regex: str, unicode_words: bool = False) -> str:
    """doc_id, start, value of every match."""
    text = f"regexp_replace(text, {lit(FOREIGN)}, {lit(STAND_IN)}, 'g')" if unicode_words else "text"
    gap = f"replace(gap, {lit(STAND_IN)}, 'x')" if unicode_words else "gap"
    return f"""(
 select doc_id, value,
   (coalesce(sum(length({gap}) + length(value)) over (partition by doc_id order by i
      rows between unbounded preceding and 1 preceding), 0) + length({gap}))::int as start
 from (select doc_id, unnest(range(1, len(m) + 1)) as i, unnest(m) as value, unnest(g[1:len(m)]) as gap
       from (select doc_id, regexp_extract_all(t, {lit(regex)}) as m, regexp_split_to_array(t, {lit(regex)}) as g
             from (select doc_id, {text} as t from {source}))))"""


PASSWORD_CLASS = r"[a-zA-Z0-9!@#$%^&*()_+=\-\[\]{}|;:'"+ r'",.<>/?`~]'


def password_spans(source: str, scope: str) -> str:
    """One match at most per maximal run of password characters: its first to its last boundary."""
    ahead = {
        "line": r"regexp_extract(substr(text, start + 1), '^[^\n]*')",
        "text": "substr(text, start + 1)",
        "token": "value",
    }[scope]
    regex = lit(PASSWORD_CLASS + "+")
    return f"""(
 select doc_id, start, value from (
  select doc_id, text, (offset_of + front)::int as start, substr(run, front + 1, length(run) - front - back) as value
  from (
   select doc_id, text, run, offset_of,
    length(case when regexp_matches(before, {lit(FOREIGN)}) then regexp_extract(run, '^[0-9A-Za-z_]*')
           else regexp_extract(run, '^[^0-9A-Za-z_]*') end)::int as front,
    length(case when regexp_matches(after, {lit(FOREIGN)}) then regexp_extract(run, '[0-9A-Za-z_]*$')
           else regexp_extract(run, '[^0-9A-Za-z_]*$') end)::int as back
   from (
    select doc_id, text, run, right(gap, 1) as before, left(next_gap, 1) as after,
     coalesce(sum(length(gap) + length(run)) over (partition by doc_id order by i
        rows between unbounded preceding and 1 preceding), 0) + length(gap) as offset_of
    from (select doc_id, text, unnest(range(1, len(m) + 1)) as i, unnest(m) as run,
            unnest(g[1:len(m)]) as gap, unnest(g[2:len(m) + 1]) as next_gap
          from (select doc_id, text, regexp_extract_all(text, {regex}) as m, regexp_split_to_array(text, {regex}) as g
                from {source}))))
  where length(run) - front - back >= 8)
 where regexp_matches({ahead}, '[a-z]') and regexp_matches({ahead}, '[A-Z]') and regexp_matches({ahead}, '[0-9]'))"""


def findings(entity: str, name: str, score: float, priority: int, found: str) -> str:
    return f"""select doc_id, {lit(entity)} as entity, {lit(name)} as pattern_name, start,
 (start + length(value))::int as "end", value, {score}::double as score, {priority}::int as priority from {found}"""


def find(entity: str, source: str, scope: str = "line") -> str:
    if entity == "PASSWORD":
        found = password_spans(source, scope)
    else:
        found = spans(source, pattern(entity), unicode_words=entity == "API_KEY")
    return findings(entity, pattern_name(entity), SCORES[entity], ENTITIES.index(entity), found)


def find_any_case(entity: str, source: str) -> str:
    found = spans(source, "(?i)" + pattern(entity), unicode_words=True)
    return findings(entity, pattern_name(entity), SCORES[entity], ENTITIES.index(entity), found)


def find_many(source: str, entities=None) -> str:
    return "\nunion all\n".join(find(r.entity, source) for r in DEFAULT_RECOGNIZERS if not entities or r.entity in entities)


def custom(source: str, entity: str, name: str, regex: str, score: float, priority: int) -> str:
    return findings(entity, name, score, priority, spans(source, regex))


SHOWN = 'doc_id, entity, start::int as start, "end"::int as "end", value, score'


def contained(found: str) -> str:
    """Drop findings inside another one."""
    return f"""(select * exclude (top) from (select *, max("end") over (partition by doc_id
   order by start, "end" desc, score desc, priority rows between unbounded preceding and 1 preceding) as top
   from ({found})) where top is null or "end" > top)"""


def clipped(found: str) -> str:
    """Cut findings at the start of the next one."""
    return f"""(select doc_id, entity, pattern_name, start, score, priority,
   least("end", coalesce(next_start, "end"))::int as "end",
   substr(value, 1, (least("end", coalesce(next_start, "end")) - start)::int) as value
   from (select *, lead(start) over (partition by doc_id order by start) as next_start from {contained(found)}))"""


def rule_sql(entity: str, rule: Rule) -> str:
    if rule.op == "replace":
        done = lit(rule.new_value)
    elif rule.from_end:
        done = (
            f"substr(value, 1, greatest(length(value) - {rule.mask_n}, 0)::int)"
            f" || repeat({lit(rule.mask_char)}, least({rule.mask_n}, length(value))::int)"
        )
    else:
        done = (
            f"repeat({lit(rule.mask_char)}, least({rule.mask_n}, length(value))::int)"
            f" || substr(value, {rule.mask_n + 1})"
        )
    return f"when {lit(entity)} then {done}"


def redacted(source: str, found: str, policy=DEFAULT_POLICY) -> str:
    """doc_id, redacted."""
    cases = " ".join(rule_sql(e, r) for e, r in policy.items())
    return f"""select d.doc_id, coalesce(r.body || substr(d.text, r.last + 1), d.text) as redacted
 from {source} d left join (
  select doc_id, string_agg(piece, '' order by start) as body, max("end")::int as last from (
   select k.doc_id, k.start, k."end", substr(d.text, (k.prev + 1)::int, (k.start - k.prev)::int)
     || case k.entity {cases} end as piece
   from (select *, coalesce(lag("end") over (partition by doc_id order by start), 0) as prev
         from {clipped(found)}) k join {source} d using (doc_id))
  group by doc_id) r using (doc_id)"""


EMAIL_REDACTED = redacted(DOCUMENTS, find("EMAIL_ADDRESS", DOCUMENTS))
ALL = find_many(DOCUMENTS)
THREE = find_many(DOCUMENTS, ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"])
HEX = custom(DOCUMENTS, "HEX_TOKEN", "hex_token", HEX_TOKEN, 0.5, 11)

LETTERS = f"(select c_custkey as doc_id, {derived.LETTER_TEXT} as text from customer)"
# Any white space in a name may be any white space in the text; a name begins and ends with a word.
SQUEEZED = r"regexp_replace({}, '\s+', ' ', 'g')"
PERSONS = f"""select doc_id, 'PERSON' as entity, 'name_list' as pattern_name, 5::int as start, (5 + length(value))::int as "end",
  value, 0.85::double as score, 4::int as priority
 from (select c_custkey as doc_id, replace({derived.LETTER_NAME}, 'del  ', 'del' || chr(10)) as value from customer)
 where {SQUEEZED.format('value')} in (select {SQUEEZED.format(derived.LETTER_NAME)} from customer)"""

ACCENTED = f"(select c_custkey as doc_id, {derived.ACCENTED} as text from customer)"


def modelled(regex: str, score: float) -> str:
    return findings("PERSON", "stand_in", score, ENTITIES.index("PERSON"), spans(ACCENTED, regex))


def find_precise(source: str) -> str:
    """All patterns, passwords with their classes in the value itself."""
    return "\nunion all\n".join(find(r.entity, source, "token" if r.entity == "PASSWORD" else "line") for r in DEFAULT_RECOGNIZERS)


# A note has one true span of each entity, and a pattern's findings do not overlap: pairs are true spans that any finding meets.
TRUE_SPANS = " union all ".join(
    f'select c_custkey as doc_id, {lit(entity)} as entity, {start} as start, {end} as "end" from customer' for entity, start, end in derived.note_spans()
)


def scores(found: str) -> str:
    return f"""with f as ({found}), t as ({TRUE_SPANS}),
 hit as (select entity, count(*) as tp from t where exists (select 1 from f
   where f.doc_id = t.doc_id and f.entity = t.entity and f.start < t."end" and t.start < f."end") group by entity),
 n as (select entity, count(*) as n_true from t group by entity), m as (select entity, count(*) as n_found from f group by entity)
select entity, n_true, coalesce(n_found, 0) as n_found, coalesce(tp, 0) as tp, coalesce(n_found, 0) - coalesce(tp, 0) as fp,
 n_true - coalesce(tp, 0) as fn, case when n_found > 0 then coalesce(tp, 0) / n_found end as precision, coalesce(tp, 0) / n_true as recall
from n left join m using (entity) left join hit using (entity)"""


LOOSE_MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MAIL_TWICE = f"""{find("EMAIL_ADDRESS", DOCUMENTS)} union all
 {custom(DOCUMENTS, "EMAIL_ADDRESS", "loose_email", LOOSE_MAIL, 0.5, 0)}"""
DEDUPED = f"""select {SHOWN} from (select *, row_number() over (partition by doc_id, entity, start, "end"
 order by score desc) as rn from ({MAIL_TWICE})) where rn = 1"""

PHRASES = f"""{custom(DOCUMENTS, "PHRASE", "pair", PAIR, 0.6, 11)} union all
 {custom(DOCUMENTS, "PHRASE", "triple", TRIPLE, 0.7, 11)}"""
MERGED = f"""select m.doc_id, m.entity, m.start::int as start, m."end"::int as "end",
 substr(d.text, m.start + 1, (m."end" - m.start)::int) as value, m.score
 from (select doc_id, entity, min(start) as start, max("end") as "end", max(score) as score
  from (select *, sum(fresh) over (partition by doc_id, entity order by start, "end" desc, score desc
          rows between unbounded preceding and current row) as island
   from (select *, case when start < max("end") over (partition by doc_id, entity order by start, "end" desc, score desc
          rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from ({PHRASES})))
  group by doc_id, entity, island) m join documents d using (doc_id)"""

MEETING = f"""{custom(DOCUMENTS, "PAIR", "pair", PAIR, 0.6, 11)} union all
 {custom(DOCUMENTS, "STOP_WORD", "stop_word", STOP_WORD, 0.7, 12)}"""

VERDICT_ROWS = """select f.entity, f.value, case when quality = 1 and toxic = 0 then ' True' || chr(10)
 when quality = 1 then 'true.' when toxic = 0 then 'TRUE' else 'False' end as response
 from ({found}) f join labels using (doc_id)"""
IS_TRUE = r"(lower(regexp_replace(response, '^\s+|\s+$', '', 'g')) = 'true')"


def with_verdicts(found: str) -> str:
    return f"""select f.*, v.verdict from ({found}) f left join (
  select entity, value, bool_and({IS_TRUE}) as verdict from ({VERDICT_ROWS.format(found=found)}) group by entity, value) v
  using (entity, value)"""


SCORED = f"{ALL} union all {HEX}"
CONFIRMED_ONLY = f"select * exclude (verdict) from ({with_verdicts(ALL)}) where coalesce(verdict, false)"
ENTRY = "entity || '=' || value || ':' || score::varchar"

SOURCES = """(select 'documents' as source, doc_id::varchar as doc_key, text from documents
 union all select 'pages', page_id::varchar, html from pages
 union all select 'conversations', conv_id::varchar || ':' || turn::varchar, text from conversations)"""
KEYED = f"(select source || '/' || doc_key as doc_id, text from {SOURCES})"
FROM_END = {**DEFAULT_POLICY, "EMAIL_ADDRESS": mask_with("*", 10, True), "CREDIT_CARD": mask_with("#", 4, True)}


def blocks(pages: str, page: str) -> str:
    return f"""select conv_id, n,
   case when length(text) > 0 then chr(10) || '--- Page ' || n::varchar || ' ---' || chr(10) || text
   else chr(10) || '--- Page ' || n::varchar || ' (No text extracted or error) ---' || chr(10) end as block
  from (select *, row_number() over (partition by conv_id order by {page} nulls last, role, text) as n from {pages})"""


BLOCKS = blocks("conversations", "turn")
SPARSE = """(select nullif(conv_id, 3) as conv_id, case when turn % 4 = 3 then null else turn * 700 end as page, role, text
 from conversations)"""


KIND = """case when source in ('src11', 'src12', 'src18') then 'image' when source = 'src13' then 'pdf'
 when source in ('src14', 'src16', 'src17') then 'other' else 'text' end"""
PATHS = f"(select doc_id, source, {derived.FILE_PATH} as path from documents)"

CHANGED = r"regexp_replace(d.text, '^\s+|\s+$', '', 'g') <> regexp_replace(r.redacted, '^\s+|\s+$', '', 'g')"
STATUS = f"""select d.doc_id, case when {CHANGED} then 'modified' else 'skipped' end as status,
 case when {CHANGED} then d.doc_id::varchar || '.backup_20250101_000000' end as backup_path, null::varchar as error
 from documents d join ({EMAIL_REDACTED}) r using (doc_id)"""
BACKUPS = """(select doc_id, '20250101_000000 ' || text as text, '20250101_000000' as ts from documents
 union all select doc_id, '20250102_000000 ' || text, '20250102_000000' from documents
   where doc_id in (select doc_id from labels)
 union all select doc_id, '20250101_120000 ' || text, '20250101_120000' from documents where lang = 'en')"""

SEEDS = {truth: ", ".join(f"({lit(e)}, {lit(v)})" for e, v, r in SEED_VERDICTS if (r == "True") == truth) for truth in (True, False)}
SEED_TRUE, SEED_FALSE = SEEDS[True], SEEDS[False]

MASKED_MAILS = f"(select doc_id, redacted as text from ({EMAIL_REDACTED}))"

# Documents written as files end with a line end; places in long texts are 64-bit numbers.
LINE_ENDED = find_many("(select doc_id, text || chr(10) as text from documents)")
LONG = """select doc_id, entity, pattern_name, start::bigint as start, "end"::bigint as "end", value, score, priority from ({})"""

ORACLES: dict[str, str] = {
    "find_email": find("EMAIL_ADDRESS", DOCUMENTS),
    "find_phone": find("PHONE_NUMBER", DOCUMENTS),
    "find_credit_card": find("CREDIT_CARD", DOCUMENTS),
    "find_api_key": find("API_KEY", DOCUMENTS),
    "find_api_key_any_case": find_any_case("API_KEY", DOCUMENTS),
    "find_password": find("PASSWORD", DOCUMENTS),
    "find_password_text_scope": find("PASSWORD", DOCUMENTS, "text"),
    "find_password_token_scope": find("PASSWORD", NOTES, "token"),
    "find_ssn": find("US_SSN", NOTES),
    "find_aadhaar": find("AADHAAR_NUMBER", NOTES),
    "find_pan": find("PAN_NUMBER", NOTES),
    "find_address": find("ADDRESS", NOTES),
    "find_ssh_key": find("SSH_KEY", NOTES),
    "find_person": PERSONS,
    "findings_all": ALL,
    "findings_notes": find_many(NOTES),
    "score_recognizers": scores(find_many(NOTES)),
    "score_confirmed": scores(f"select * from {clipped(find_precise(NOTES))}"),
    "findings_model": f"""select * exclude (priority) from ({find_many(ACCENTED)} union all {modelled("Customer#[0-9]+", 0.9)}
 union all {modelled("Contact Customer#", 0.85)})""",
    # Two spans of one name overlap, so they are one span, from the first one's begin to the second one's end.
    "redact_with_model": redacted(ACCENTED, f"{find_many(ACCENTED)} union all {modelled('Contact Customer#[0-9]+', 0.9)}"),
    "findings_allow_list": THREE,
    "findings_custom_recognizer": f"{find('EMAIL_ADDRESS', DOCUMENTS)} union all {HEX}",
    "findings_many": f"""{find_many(NOTES, ["EMAIL_ADDRESS", "US_SSN"])} union all
 select * replace ('account_' || doc_id::varchar as pattern_name) from ({custom(NOTES, "ACCOUNT", "", "u[0-9]+@mail[.]example[.]com", 0.7, 11)})""",
    "findings_provenance": "select doc_id, entity, pattern_name, case entity "
    + " ".join(
        f"when {lit(r.entity)} then {lit(r.regex)}"
        for r in DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"])
    )
    + f' end as regex, start, "end", score from ({THREE})',
    "dedupe_findings": DEDUPED,
    "merge_same_entity": MERGED,
    "drop_contained": f"select {SHOWN} from {contained(find_many(NOTES))}",
    "clip_overlaps": f"select {SHOWN} from {clipped(MEETING)}",
    "resolve_notes": f"select {SHOWN} from {clipped(find_many(NOTES))}",
    "redact_email": EMAIL_REDACTED,
    "redact_credit_card": redacted(DOCUMENTS, find("CREDIT_CARD", DOCUMENTS)),
    "redact_phone_ssn": redacted(NOTES, find_many(NOTES, ["PHONE_NUMBER", "US_SSN"])),
    "redact_aadhaar_pan": redacted(NOTES, find_many(NOTES, ["AADHAAR_NUMBER", "PAN_NUMBER"])),
    "redact_replace": redacted(NOTES, find_many(NOTES, ["ADDRESS", "SSH_KEY", "API_KEY"])),
    "redact_all": redacted(DOCUMENTS, ALL),
    "redact_notes": redacted(NOTES, find_many(NOTES)),
    "redact_from_end": redacted(DOCUMENTS, find_many(DOCUMENTS, ["EMAIL_ADDRESS", "CREDIT_CARD"]), FROM_END),
    "redact_with_names": redacted(LETTERS, f"{find_many(LETTERS)} union all {PERSONS}"),
    "verify_join": f"select doc_id, entity, start, value, coalesce(verdict::varchar, 'missing') as verdict from ({with_verdicts(ALL)})",
    "verify_parse": f"select entity, value, response, {IS_TRUE} as verdict from ({VERDICT_ROWS.format(found=ALL)})",
    "verify_fail_closed": f"""select doc_id, entity, start, value, score from ({with_verdicts(SCORED)})
 where coalesce(verdict, false) and score >= {MIN_SCORE}""",
    "verify_score_gate": f"""select doc_id, entity, start, value, score from ({with_verdicts(SCORED)})
 where coalesce(verdict, true) and score >= {MIN_SCORE}""",
    "verify_failed_keep": redacted(DOCUMENTS, f"select * from ({ALL}) where contains(value, '7') or contains(value, '3')"),
    "verify_seeded": f"""select doc_id, entity, start, value, score from ({with_verdicts(ALL)}) f
 where coalesce(verdict, false) and score >= {MIN_SCORE} and (entity, value) not in ({SEED_FALSE})
 union all select doc_id, entity, start, value, score from ({with_verdicts(ALL)})
 where verdict is null and score >= {MIN_SCORE} and (entity, value) in ({SEED_TRUE})""",
    "redact_custom": redacted(DOCUMENTS, find("EMAIL_ADDRESS", DOCUMENTS)).replace(
        rule_sql("EMAIL_ADDRESS", DEFAULT_POLICY["EMAIL_ADDRESS"]),
        "when 'EMAIL_ADDRESS' then case when contains(value, '7') then repeat('*', length(value)::int) "
        "else '<' || length(value)::varchar || '>' end",
    ),
    "redact_udf": redacted(DOCUMENTS, find_many(DOCUMENTS, ["EMAIL_ADDRESS", "CREDIT_CARD"])).replace(
        rule_sql("EMAIL_ADDRESS", DEFAULT_POLICY["EMAIL_ADDRESS"]),
        "when 'EMAIL_ADDRESS' then case when contains(value, '7') then repeat('*', length(value)::int) "
        "else 'user-' || substr(sha256(value), 1, 8) end",
    ),
    "redacted_in_order": EMAIL_REDACTED,
    "find_in_language": find_many("(select doc_id, text from documents where lang = 'en')", ["EMAIL_ADDRESS", "CREDIT_CARD"]),
    "verify_distinct": f"select entity, value, count(*) as n_findings from ({ALL}) group by entity, value",
    "verify_classified": f"""select distinct entity, value,
 case when contains(value, '7') then 'True' else 'False' end as response from ({ALL})""",
    "verify_incremental": f"""select entity, value, case when contains(value, '7') then 'True' else 'False' end as response, min(round)::int as round
 from (select entity, value, 1 as round from ({ALL}) union all select entity, value, 2 from ({find_many(KEYED)})) group by entity, value""",
    "verify_from_store": f"""select doc_id, entity, start, value, score from ({ALL}) where contains(value, '7') and score >= {MIN_SCORE}""",
    "verify_redacted": redacted(DOCUMENTS, CONFIRMED_ONLY),
    "report_entries": f'select doc_id, start, "end", {ENTRY} as entry from ({ALL})',
    "report_confirmed": f'select doc_id, start, "end", {ENTRY} || {lit(CONFIRMED)} as entry from ({CONFIRMED_ONLY})',
    "report_joined": f"""select d.doc_id, coalesce(r.report, {lit(NOTHING_FOUND)}) as report from documents d left join (
  select doc_id, string_agg({ENTRY}, chr(10) order by start, "end" desc, score desc, priority, pattern_name) as report
  from ({ALL}) group by doc_id) r using (doc_id)""",
    "report_hashed": f'select doc_id, entity, start, "end", sha256(value) as value_hash from ({ALL})',
    "count_by_entity": f"select entity, count(*) as n from ({ALL}) group by entity",
    "count_by_doc": f"""select d.doc_id, coalesce(c.n, 0)::int as n from documents d
 left join (select doc_id, count(*) as n from ({ALL}) group by doc_id) c using (doc_id)""",
    "pivot_by_doc": "select d.doc_id, "
    + ", ".join(
        f"(count(*) filter (where f.entity = {lit(e)}))::int as {e.lower()}" for e in ENTITIES if e != "PERSON"
    )
    + f" from {NOTES} d left join ({find_many(NOTES)}) f using (doc_id) group by d.doc_id",
    "rollup_source_entity": f"""select coalesce(source, '(all)') as source, coalesce(entity, '(all)') as entity, n from (
  select source, entity, count(*) as n from (select split_part(doc_id, '/', 1) as source, entity from ({find_many(KEYED)}))
  group by rollup (source, entity))""",
    "union_sources": f"select * from {SOURCES}",
    "scan_count": f"select source, count(*) as n_documents from {SOURCES} group by source",
    "filter_url_sources": "select page_id, url from pages where url like 'http://%' or url like 'https://%'",
    "repository_flags": f"""select url as input, (url like 'http://%' or url like 'https://%') as is_repository from pages
 union all select path, false from {PATHS}""",
    "path_problems": f"""select url as input, case when url like 'http://%' or url like 'https://%'
   then 'check the repository out first and scan its directory' end as problem from pages
 union all select case when source = 'src10' then ' ' || chr(9) when source <> 'src11' then path end,
   case when source in ('src10', 'src11') then 'no input directory given' end from {PATHS}""",
    "page_blocks": BLOCKS,
    "page_blocks_sparse": blocks(SPARSE, "page"),
    "assemble_pages": f"select conv_id, string_agg(block, '' order by n) as text from ({BLOCKS}) group by conv_id",
    "assemble_pages_in_segments": f"""select conv_id, ((n - 1) // 3)::int as segment, string_agg(block, '' order by n) as text
 from ({BLOCKS}) group by conv_id, (n - 1) // 3""",
    "classify_paths": f"select doc_id, path, {KIND} as kind from {PATHS}",
    "text_paths": f"select doc_id, path from {PATHS} where ({KIND}) = 'text' and source <> 'src19'",
    "kind_coverage": f"select {KIND} as kind, count(*) as n from documents group by 1",
    "scan_tree": "select doc_id, text || chr(10) as text from documents",
    "check_tree": f"""select doc_id, case when d.text <> r.redacted then r.redacted else d.text end || chr(10) as text,
 case when {CHANGED} then 'modified' else 'skipped' end as status
 from documents d join ({redacted(DOCUMENTS, find_many(DOCUMENTS, ["EMAIL_ADDRESS", "CREDIT_CARD"]))}) r using (doc_id)""",
    "scan_hidden_tree": r"""select doc_id, case doc_id % 3 when 0 then '.a' when 1 then '.c' else 'c' end as folder, text || chr(10) as text,
 'utf-8' as encoding from documents""",
    "scan_in_ranges": f'select doc_id, entity, start::bigint as start, "end"::bigint as "end", value, score from ({LINE_ENDED})',
    "scrub_unreadable": f"""select doc_id, status, null::varchar as error from ({STATUS})
 union all select doc_id, 'errors', 'Failed modifying : No such file or directory' from documents where doc_id % 3 = 0""",
    "findings_segmented": LONG.format(ALL),
    "findings_segmented_notes": LONG.format(find_many(NOTES)),
    "findings_segmented_text_scope": LONG.format(find("PASSWORD", DOCUMENTS, "text")),
    "redact_segmented": redacted(DOCUMENTS, ALL),
    "empty_files": rf"""select doc_id, strlen(regexp_extract(t, '(?m)^[^\n]{{60,}}$'))::bigint as length
 from (select p.*, case when p.source = 'src6' then chr(65279) || d.text else d.text end as t
       from documents d join {PATHS} p using (doc_id))
 where ({KIND}) = 'text' and source <> 'src19' and regexp_matches(t, '(?m)^[^\n]{{60,}}$')""",
    "decode_fallback": "select doc_id, case when source = 'src6' then chr(65279) || text else text end as text from documents",
    "file_encodings": r"""select doc_id, case when source in ('src0', 'src1', 'src2', 'src5')
   and regexp_matches(text, '[^\x00-\x7F]') then 'latin-1' else 'utf-8' end as encoding,
 (source in ('src3', 'src4', 'src5') and contains(text, chr(10))) as had_crlf from documents""",
    "scrub_status": STATUS,
    "scrub_append": f"""select d.doc_id, d.text || chr(10) || r.redacted as text
 from documents d join ({EMAIL_REDACTED}) r using (doc_id)""",
    "scrub_summary": f"select status, count(*) as n_files, count(backup_path) as n_backups from ({STATUS}) group by status",
    "scrub_errors": f"""select doc_id, case when m.sevens > 0 then 'errors' when m.n > 0 then 'modified' else 'skipped' end as status,
 null::varchar as backup_path,
 case when m.sevens > 0 then 'Failed modifying ' || doc_id::varchar || ': no redacted text' end as error
 from documents left join (select doc_id, count(*) as n, count(*) filter (where contains(value, '7')) as sevens
   from ({find("EMAIL_ADDRESS", DOCUMENTS)}) group by doc_id) m using (doc_id)""",
    "unmatched_results": """select doc_id, 'no redacted result' as problem from documents
 where doc_id not in (select doc_id from labels)
 union all select doc_id, 'no source document' from labels where doc_id not in (select doc_id from documents)""",
    "empty_input": """select null::varchar as path, 'errors' as status, null::varchar as backup_path,
 'No text files found.' as error where (select count(*) from documents where text is null) = 0""",
    "backup_rows": f"select d.doc_id, d.text from documents d join ({STATUS}) s using (doc_id) where s.status = 'modified'",
    "latest_backup": f"""select doc_id, ts, text from (
  select *, row_number() over (partition by doc_id order by ts desc) as rn from {BACKUPS}) where rn = 1""",
    "restore": "select doc_id, text from documents",
    "restore_written": "select doc_id, text from documents",
    "read_merged": f"select doc_id, redacted as text from ({redacted(MASKED_MAILS, find('CREDIT_CARD', MASKED_MAILS))})",
    "changed_only": f"""select doc_id, s.status, case when s.status = 'modified' then length(r.redacted) end::int as new_chars,
 case when s.status = 'modified' then length(d.text) end::int as original_chars
 from documents d join ({EMAIL_REDACTED}) r using (doc_id) join ({STATUS}) s using (doc_id)""",
    "stream_scrub": f"""select doc_id, redacted as text, case when redacted <> text then 'modified' else 'skipped' end as status
 from ({redacted(LETTERS, f"{find_many(LETTERS)} union all {PERSONS}")}) join {LETTERS} using (doc_id)""",
    "write_versions": f"""select doc_id, r.redacted as text, s.status
 from ({EMAIL_REDACTED}) r join ({STATUS}) s using (doc_id)""",
}
