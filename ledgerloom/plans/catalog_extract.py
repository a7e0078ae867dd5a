"""Registered queries over text: lines, detection, extraction and text functions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators import classify as K
from ledgerloom.operators import detect as D
from ledgerloom.operators import extract as P
from ledgerloom.operators import spend as S
from ledgerloom.operators import suggest as G
from ledgerloom.operators.memory import ClassificationMemory
from ledgerloom.operators.scan import key_sizes
from ledgerloom.plans import check_sql as C
from ledgerloom.plans import render as RD
from ledgerloom.plans import testview as T
from ledgerloom.plans.check_sql import d, n, on_ledger, on_statements, s
from ledgerloom.plans.registry import SQL, add
from ledgerloom.sources import lines as LN
from ledgerloom.sources.rules import Rules
from ledgerloom.storage import checkpoint_root

RUN, CARD, SEC, ANC = "chase_checking", "chase_credit", "boa_checking", "wellsfargo_checking"


def layout(k, f, name):
    return P.of_layout(RD.lines(k, f), name)


def periods(k, f, name):
    return P.extract_period(layout(k, f, name), P.SPECS[name])


# --- lines -----------------------------------------------------------------------------
def conversation_pages(k, f):
    return T.read(k, f, "conversations").selectExpr("conv_id as stmt_id", "cast(turn as int) + 1 as page_no", "text")


def whole_texts(k, f):
    """Each document as one page that no page comes before."""
    return T.read(k, f, "documents").selectExpr("doc_id as stmt_id", "1 as page_no", "text", "0 as offset")


def lines_sql(source: str) -> str:
    blank = "regexp_replace(trim(regexp_replace(regexp_replace(part, '[ \\t\\x{00A0}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), '^ +| +$', '', 'g')"
    return f"""with pages0 as ({source}), sized as (select *, string_split(text, chr(10)) as parts from pages0),
 off as (select *, coalesce(sum(len(parts)) over (partition by stmt_id order by page_no rows between unbounded preceding and 1 preceding), 0) as o from sized),
 ex as (select stmt_id, page_no, o, unnest(parts) as part, generate_subscripts(parts, 1) as pos from off)
 select stmt_id, cast(page_no as int) as page_no, cast(o + pos as int) as line_no, {blank} as text from ex where {blank} <> ''"""


add("s2_explode_lines", lambda k, f: LN.explode_lines(whole_texts(k, f)),
    lines_sql("select doc_id as stmt_id, 1 as page_no, text from documents"))
add("s2_explode_lines_pages", lambda k, f: LN.explode_lines(conversation_pages(k, f)),
    lines_sql("select conv_id as stmt_id, cast(turn as int) + 1 as page_no, text from conversations"))
add("d19_drop_noise", lambda k, f: P.drop_noise(LN.explode_lines(whole_texts(k, f)),
                                                r"^(Copyright|Licensed|https?://|[^a-zA-Z]*$)"),
    f"select * from ({lines_sql('select doc_id as stmt_id, 1 as page_no, text from documents')}) where not regexp_matches(text, '^(Copyright|Licensed|https?://|[^a-zA-Z]*$)')")

# --- detection ----------------------------------------------------------------------------
MARKERS = [  # an invented registry over the words of the documents
    ("license", "License page", "text", 1, ["License", "license"], ["Copyright", "http", "warranty"]),
    ("contact", "Contact page", "text", 1, ["@"], ["http", "www", "phone", "Tel"]),
    ("prose", "Prose", "text", 1, ["the "], ["and", "that", "ing"]),
]


def score_sql(text: str, registry) -> list[str]:
    return [f"case when {' or '.join(f'contains({text}, {C.lit(r)})' for r in req)} then 1 + "
            + " + ".join(f"cast(contains({text}, {C.lit(m)}) as int)" for m in marks) + " else 0 end" for *_, req, marks in registry]


def detect_sql(source: str, registry, reason_pages: int = 3) -> str:
    scores = score_sql("opening", registry)
    long = " union all ".join(f"select stmt_id, {i} as ord, {C.lit(r[0])} as name, {C.lit(r[1])} as label, {sc} as score from src"
                              for i, (r, sc) in enumerate(zip(registry, scores)))
    return f"""src as ({source}), sc as ({long}),
 rk as (select *, row_number() over (partition by stmt_id order by score desc, ord) as rn from sc),
 det as (select src.stmt_id, case when b.score > 0 then b.name end as layout_name, case when b.score > 0 then b.label end as label, b.score,
  case when opening is null or regexp_replace(opening, '\\s+', '', 'g') = '' then 'the first 3 pages hold no text'
   when b.score = 0 then {C.lit('none of the known layouts: ' + ', '.join(r[1] for r in registry))} end as error,
  coalesce((select string_agg(label, ', ' order by score desc, ord) from rk o where o.stmt_id = src.stmt_id and rn > 1 and o.score > 0 and b.score > 0), '') as runners_up
  from src join rk b on b.stmt_id = src.stmt_id and rn = 1)"""


def document_pages(k, f):
    return T.read(k, f, "documents").selectExpr("doc_id as stmt_id", "1 as page_no", "text")


add("d1_score_formats", lambda k, f: D.score_formats(T.read(k, f, "documents"), "doc_id", "text", MARKERS).select("doc_id", "name", "score"),
    " union all ".join(f"select doc_id, {C.lit(r[0])} as name, {sc} as score from documents" for r, sc in zip(MARKERS, score_sql("text", MARKERS))))
add("d2_detect", lambda k, f: D.detect(document_pages(k, f), layouts=MARKERS).withColumn("runners_up", F.array_join("runners_up", ", ")),
    "with " + detect_sql("select doc_id as stmt_id, text as opening from documents", MARKERS) + " select * from det")
add("d2_detect_pages", lambda k, f: D.detect(conversation_pages(k, f), layouts=MARKERS).withColumn("runners_up", F.array_join("runners_up", ", ")),
    "with " + detect_sql("select conv_id as stmt_id, string_agg(text, chr(10) order by turn) as opening from conversations where turn < 3 group by 1", MARKERS) + " select * from det")


add("d2_detect_statements", lambda k, f: D.detect(RD.lines(k, f)).select("stmt_id", "layout_name", "score"),
    on_statements("""select stmt_id, layout_name, case layout_name when 'chase_checking' then 4 + cast(owner % 2 = 0 as int)
 when 'chase_credit' then 3 + cast(owner % 2 = 0 as int) when 'boa_checking' then 4 else 3 end as score from stmts"""))
add("d3_detection_summary", lambda k, f: D.detection_summary(D.detect(document_pages(k, f), layouts=MARKERS[:2])),
    "with " + detect_sql("select doc_id as stmt_id, text as opening from documents", MARKERS[:2]) +
    " select coalesce(label, 'skipped') as label, case when layout_name is null then error end as reason, count(*) as documents from det group by 1, 2")

# --- header fields ---------------------------------------------------------------------------
for _name in (RUN, CARD, SEC, ANC):
    add(f"d8_extract_period_{_name}", lambda k, f, x=_name: periods(k, f, x),
        on_statements(f"select stmt_id, {s('period_start')}, {s('period_end')} from stmts where layout_name = '{_name}'"))
    add(f"d9_account_last4_{_name}", lambda k, f, x=_name: P.extract_account_last4(layout(k, f, x), P.SPECS[x]),
        on_statements(f"select stmt_id, account_last4 from stmts where layout_name = '{_name}'"))


def summaries(k, f, name):
    lines, spec = layout(k, f, name), P.SPECS[name]
    return P.layout_summary(lines, spec, P.header_fields(lines, spec))


for _name in (RUN, CARD, SEC, ANC):
    add(f"d10_extract_summary_{_name}", lambda k, f, x=_name: summaries(k, f, x),
        on_statements(f"select stmt_id, key, {d('v', 'value')} from (unpivot (select stmt_id, {', '.join(T.SUMMARY_COLUMNS)} from stmts where layout_name = '{_name}') "
                      f"on {', '.join(T.SUMMARY_COLUMNS)} into name key value v)"))

# --- rows ------------------------------------------------------------------------------------
_SECTION = "case when amount > 0 then 'Deposits and other additions' else 'Other subtractions' end"
def _long_day(column):
    return f"strftime({column}, '%B %-d, %Y')"


def _figure(column):
    return f"format('{{:,.2f}}', cast({column} as double))"


_HEAD_LINES = [  # text and section of the lines of a sectioned statement that are no rows
    ("'bankofamerica.com'", "null"), ("'Account summary'", "null"), ("'a line outside every section'", "null"),
    (f"'for ' || {_long_day('period_start')} || ' to ' || {_long_day('period_end')} || ' Account number: 0000 0000 ' || account_last4", "null"),
    (f"'Beginning balance on ' || {_long_day('period_start')} || ' $' || {_figure('beginning_balance')}", "null"),
    (f"'Deposits and other additions ' || {_figure('deposits')}", "null"), (f"'Other subtractions ' || {_figure('other_subtractions')}", "null"),
    (f"'Ending balance on ' || {_long_day('period_end')} || ' $' || {_figure('ending_balance')}", "null"),
    ("'Deposits and other additions'", "'Deposits and other additions'"), ("'Date Description Amount'", "'Deposits and other additions'"),
    (f"'Total deposits and other additions $' || {_figure('total_deposits')}", "null"), ("'Withdrawals and other subtractions'", "null"),
    ("'Other subtractions'", "'Other subtractions'"), (f"'Total other subtractions $' || {_figure('total_other_subtractions')}", "null")]
_ROW_LINES = [
    (f"strftime(date, '%m/%d/%y') || ' ' || description || ' ' || {_figure('amount')}", _SECTION, "true"), ("'WEB'", _SECTION, "txn_id % 4 = 1"),
    (C.lit(RD.LONG_LINE.strip()), _SECTION, "txn_id % 36 = 2"), ("'continued on the next page'", "null", "txn_id % 10 = 3"),
    (f"{_SECTION} || ' - continued'", _SECTION, "txn_id % 10 = 3")]
add("d11_assign_section", lambda k, f: P.assign_section(layout(k, f, SEC)).select("stmt_id", "text", "section"),
    on_statements("select * from (" + " union all ".join(
        [f"select stmt_id, {t} as text, {c} as section from stmts where layout_name = '{SEC}'" for t, c in _HEAD_LINES]
        + [f"select stmt_id, {t}, {c} from tx where layout_name = '{SEC}' and {w}" for t, c, w in _ROW_LINES]) + ") where text is not null"))


def parsed(k, f, name):
    reading = RD.layout_lines(k, f) if name == CARD else None
    lines, spec = layout(k, f, name), P.SPECS[name]
    sizes = key_sizes(lines, P.DOC)
    dates = P.header_fields(lines, spec, sizes).select("stmt_id", "period_start", "period_end")
    return P.parse_layout(lines, spec, dates, reading, sizes)


OUT = ["stmt_id", "date", "description", "amount", "kind"]


def rows_of(k, f, name):
    return parsed(k, f, name).where("outcome = 'row'")


from ledgerloom.plans.catalog_ledger import BREAKS  # noqa: E402

add("d12_assemble_wrapped_rows", lambda k, f: rows_of(k, f, RUN).select(*OUT, "balance"),
    on_statements(f"select stmt_id, {s('date')}, description, {d('amount')}, kind, {d('balance')} from printed", BREAKS))
add("d12_assemble_anchored_rows", lambda k, f: rows_of(k, f, ANC).select(*OUT),
    f"with {C.TX} select stmt_id, {s('date')}, description, {d('amount')}, kind from tx where layout_name = '{ANC}'")
add("d13_append_continuations", lambda k, f: rows_of(k, f, SEC).select(*OUT),
    f"with {C.TX} select stmt_id, {s('date')}, description || case when txn_id % 4 = 1 then ' WEB' else '' end as description, {d('amount')}, kind from tx where layout_name = '{SEC}'")
add("d14_extract_multi", lambda k, f: P.extract_multi(P.slice_between(layout(k, f, ANC), P.find_anchors(layout(k, f, ANC)), "a3", "a4")).select("stmt_id", "number", "mm", "dd", "amount"),
    f"with {C.TX} select stmt_id, substr(description, 7) as number, strftime(date, '%m') as mm, strftime(date, '%d') as dd, {d('-amount', 'amount')} from tx where layout_name = '{ANC}' and description like 'Check %'")
_WITHDRAWN = f"layout_name = '{ANC}' and amount < 0 and description not like 'Check %'"
add("d15_slice_between", lambda k, f: P.slice_between(layout(k, f, ANC), P.find_anchors(layout(k, f, ANC)), "a5", "a6").select("stmt_id", "text"),
    on_statements(f"""select stmt_id, 'Other withdrawals' as text from stmts where layout_name = '{ANC}' union all
 select stmt_id, strftime(date, '%m/%d') || ' ' || description || case when txn_id % 3 = 1 then '' else ' ' || {_figure('-amount')} end from tx where {_WITHDRAWN}
 union all select stmt_id, {_figure('-amount')} from tx where {_WITHDRAWN} and txn_id % 3 = 1"""))
_CARD = f"""card as (select *, description || case when kind = 'payment' then ' PAYMENT' else '' end as printed_text,
 case kind when 'purchase' then kind when 'cash_advance' then kind when 'fee' then kind when 'interest' then kind else 'payment' end as section,
 strftime(date, '%m/%d') as mmdd from tx where layout_name = '{CARD}'),
 lab as (select stmt_id, mmdd, amount, min(section) as section from card group by 1, 2, 3 having count(distinct section) = 1)"""
add("d16_section_lookup", lambda k, f: P.section_labels(RD.layout_lines(k, f)),
    f"with {C.TX}, {_CARD} select stmt_id, mmdd, {d('amount')}, section from lab")
add("j6_rows_to_sections", lambda k, f: P.section_lookup(
        T.ledger(k, f).where(f"layout_name = '{CARD}'").select("txn_id", "stmt_id", F.date_format("date", "MM/dd").alias("mmdd"), "amount"),
        P.section_labels(RD.layout_lines(k, f))).select("txn_id", "section"),
    f"with {C.TX}, {_CARD} select txn_id, lab.section from card left join lab using (stmt_id, mmdd, amount)")
add("d17_classify_kind", lambda k, f: rows_of(k, f, CARD).select(*OUT),
    f"""with {C.TX}, {_CARD} select stmt_id, {s('date')}, printed_text as description, {d('amount')},
 case when amount < 0 then case when {C.has('printed_text', V.CARD_PAYMENT_WORDS)} then 'payment' else 'credit' end
  when lab.section is not null then lab.section when {C.has('printed_text', V.CARD_INTEREST_WORDS)} then 'interest'
  when {C.has('printed_text', V.CARD_FEE_WORDS)} then 'fee' else 'purchase' end as kind from card left join lab using (stmt_id, mmdd, amount)""")
add("d18_strip_envelope", lambda k, f: T.ledger(k, f).select("txn_id", X.strip_envelope(F.col("description")).alias("inner_text")),
    f"with {C.TX} select txn_id, {C.envelope('description')} as inner_text from tx")
add("d20_unparsed_report", lambda k, f: P.unparsed_report(reduce(
        lambda a, b: a.unionByName(b), [parsed(k, f, name) for name in P.SPECS])).select("stmt_id", "text"),
    f"""with {C.TX} select stmt_id, strftime(date, '%m/%d') || ' No amount here' as text from tx where layout_name = '{RUN}' and txn_id % 35 = 4
 union all select stmt_id, 'See reverse side' from tx where layout_name = '{RUN}' and txn_id % 97 = 0
 union all select stmt_id, {C.lit(RD.LONG_LINE.strip())} from tx where layout_name = '{SEC}' and txn_id % 36 = 2""")

# --- money and dates -----------------------------------------------------------------------------
_DIGITS = ("case when o_totalprice >= 1000 then cast(cast(floor(o_totalprice / 1000) as int) as string) || ',' || "
           "lpad(cast(cast(floor(o_totalprice) as int) % 1000 as string), 3, '0') else cast(cast(floor(o_totalprice) as int) as string) end || '.' || lpad(cast(o_orderkey % 100 as string), 2, '0')")
PRINTED = f"""case o_orderkey % 7 when 0 then {_DIGITS} when 1 then '$' || {_DIGITS} when 2 then '-$' || {_DIGITS} when 3 then '$-' || {_DIGITS}
 when 4 then '+' || {_DIGITS} when 5 then '.' || lpad(cast(o_orderkey % 100 as string), 2, '0') else '- ' || {_DIGITS} end"""
add("d5_parse_money", lambda k, f: T.read(k, f, "orders").selectExpr("o_orderkey", f"{PRINTED} as printed").select("o_orderkey", X.parse_money(F.col("printed")).alias("value")),
    f"""select o_orderkey, {d("case when o_orderkey % 7 in (2, 3, 6) then -1 else 1 end * (case when o_orderkey % 7 = 5 then 0 else cast(floor(o_totalprice) as decimal(18,2)) end + cast(o_orderkey % 100 as decimal(18,2)) / 100)", 'value')} from orders""")
_SHIFT = "cast(cast(o_orderdate as date) - interval 1 day * (o_orderkey % 90) as date)"
add("d6_resolve_year", lambda k, f: T.read(k, f, "orders").selectExpr(
        "o_orderkey", "month(o_orderdate) as mm", "day(o_orderdate) as dd", "date_sub(cast(o_orderdate as date), cast(o_orderkey % 90 as int)) as st")
    .select("o_orderkey", X.resolve_year(F.col("mm"), F.col("dd"), F.col("st"), F.date_add("st", 30)).alias("resolved")),
    f"""with p as (select o_orderkey, cast(o_orderdate as date) as dt, cast(o_orderdate as date) - cast(o_orderkey % 90 as int) as st from orders),
 c as (select o_orderkey, st, st + 30 as en, dt, unnest(list_distinct([year(st), year(st + 30)])) as y from p),
 v as (select o_orderkey, st, en, try_cast(y || '-' || strftime(dt, '%m-%d') as date) as cd from c),
 k as (select o_orderkey, cd, case when cd < st then st - cd when cd > en then cd - en else 0 end as cost from v where cd is not null),
 b as (select o_orderkey, arg_min(cd, (cost, cd)) as cd, min(cost) as cost from k group by 1)
 select o.o_orderkey, {s("case when cost <= 45 then cd end", 'resolved')} from orders o left join b using (o_orderkey)""")
add("d7_year_for", lambda k, f: T.read(k, f, "orders").select("o_orderkey", X.year_for(
        F.month("o_orderdate"), F.least(F.day("o_orderdate"), F.lit(28)), F.date_add(F.to_date("o_orderdate"), 60)).alias("resolved")),
    """select o_orderkey, cast(make_date(year(cl) - case when month(o_orderdate) > month(cl) then 1 else 0 end, month(o_orderdate), least(day(o_orderdate), 28)) as string) as resolved
 from (select *, cast(o_orderdate as date) + 60 as cl from orders)""")
add("t16_month_keys", lambda k, f: T.ledger(k, f).select("txn_id", X.month_key(F.col("date")).alias("month_key"), X.iso_date(F.col("date")).alias("iso"), X.month_label(F.col("date")).alias("label")),
    f"with {C.TX} select txn_id, strftime(date, '%Y-%m') as month_key, strftime(date, '%Y-%m-%d') as iso, strftime(date, '%b %y') as label from tx")

# --- descriptor functions -----------------------------------------------------------------------------
add("t1_ach_originator", lambda k, f: T.ledger(k, f).select("txn_id", X.ach_originator(F.col("description")).alias("originator")),
    f"with {C.TX} select txn_id, {C.originator('description')} as originator from tx")
add("t2_strip_ach_tail", lambda k, f: T.ledger(k, f).select("txn_id", X.strip_ach_tail(F.col("description")).alias("payee")),
    f"with {C.TX} select txn_id, trim({C.sub('description', V.ACH_TAIL)}) as payee from tx")
add("t3_strip_channel_prefix", lambda k, f: T.ledger(k, f).select("txn_id", X.strip_channel_prefix(F.col("description")).alias("rest")),
    f"with {C.TX} select txn_id, {C.sub('description', V.CHANNEL_PREFIX)} as rest from tx")
add("t4_strip_codes", lambda k, f: T.ledger(k, f).select("txn_id", X.strip_codes(F.col("description")).alias("rest")),
    f"with {C.TX} select txn_id, {C.codes('description')} as rest from tx")
add("t5_strip_city_state", lambda k, f: X.with_city_state_stripped(T.ledger(k, f).select("txn_id", X.squeeze(F.col("description")).alias("raw")), "raw", "name").select("txn_id", "name"),
    f"""with {C.TX}, a as (select txn_id, {C.squeeze('description')} as raw from tx),
 b as (select *, {C.grp('raw', V.CITY_STATE)} as city, {C.sub('raw', V.CITY_STATE)} as head from a), c as (select *, string_split(city, ' ') as w from b),
 e as (select *, trim(upper(w[-1]), '.') as last from c)
 select txn_id, case when city = '' then raw else rtrim(head || ' ' || array_to_string(w[1:len(w) - case
  when len(w) > 1 and replace(upper(array_to_string(w[greatest(len(w) - 2, 1):len(w)], ' ')), '.', '') in {C.in_list(V.MULTIWORD_CITIES)} then least(len(w), 3)
  when len(w) > 1 and replace(upper(array_to_string(w[len(w) - 1:len(w)], ' ')), '.', '') in {C.in_list(V.MULTIWORD_CITIES)} then 2
  when last in {C.in_list(V.COMPANY_SUFFIXES)} or {' or '.join(C.has('last', p) for p, _ in V.NAME_HINTS)} then 0 else 1 end], ' ')) end as name from e""")
add("t6_clean", lambda k, f: X.with_clean(T.ledger(k, f).select("txn_id", "description"), "description", "name").select("txn_id", "name"),
    f"with {C.TX}, {C.cleaned('tx', 'description', 'cn')} select txn_id, cn as name from cn_z")
add("t7_titlecase", lambda k, f: T.ledger(k, f).select("txn_id", X.titlecase(F.col("description")).alias("name")),
    f"with {C.TX} select txn_id, {C.titlecase('description')} as name from tx")
_P2P = "description like 'Zelle Payment To%'"
add("t8_p2p", lambda k, f: K.with_rail_outcome(T.ledger(k, f), "description", T.USER_RULES.payees, "hit").select(
        "txn_id", X.rail_counterparty(F.col("description")).alias("who"), F.col("hit.merchant").alias("label"), F.col("hit.category").alias("rail_category")),
    f"""with {C.TX} select txn_id, case when {_P2P} then case when description like '%Alex%' then 'ALEX' when description like '%Robin%' then 'ROBIN'
 when description like '%Casey%' then 'CASEY JONES' else '' end end as who,
 case when description like 'Zelle Payment From%' then 'Zelle received' when description like 'Zelle Payment To Alex%' then 'Rent (Alex)'
  when description like 'Zelle Payment To Robin%' then 'Cleaning (Robin)' when description like 'Zelle Payment To Casey%' then 'To Casey Jones'
  when description like 'Zelle Payment%' then 'Person-to-person payment' end as label,
 case when description like 'Zelle Payment From%' then 'Income' when description like 'Zelle Payment To Alex%' then 'Housing'
  when description like 'Zelle Payment To Robin%' then 'Household' when description like 'Zelle Payment%' then 'People & Services' end as rail_category from tx""")
add("t9_inflow", lambda k, f: K.with_classification(T.transactions(k, f).where("kind = 'deposit'"), T.USER_RULES).select("txn_id", "merchant", "category"),
    on_ledger("select txn_id, merchant, category from ledger where kind = 'deposit'"))
add("t10_normalize", lambda k, f: K.with_classification(T.transactions(k, f), T.USER_RULES).select("txn_id", "merchant", "category"),
    on_ledger("select txn_id, merchant, category from ledger"))
add("t10_normalize_documents", lambda k, f: K.classification_table(T.read(k, f, "documents").selectExpr(
        "regexp_replace(text, '[^A-Za-z0-9 .#*-]+', ' ') as description", "'' as descriptor", "'credit' as account",
        "case when doc_id % 5 = 0 then 'credit' else 'purchase' end as kind")).select(F.sha2("text", 256).alias("text_hash"), "kind", F.sha2("merchant", 256).alias("merchant_hash"), "category"),
    f"""with docs as (select distinct regexp_replace(text, '[^A-Za-z0-9 .#*-]+', ' ', 'g') as text, 'credit' as account,
 case when doc_id % 5 = 0 then 'credit' else 'purchase' end as kind from documents), {C.classified('docs', Rules([('~', '~', '~')], [('~', '~', '~')], [('~~~', '~', '~')]))}
 select sha256(text) as text_hash, kind, sha256(merchant) as merchant_hash, category from outcome""")
add("t11_category_hint", lambda k, f: X.with_category_hint(T.ledger(k, f).select("txn_id", "description"), "description", "hint").select("txn_id", "hint"),
    f"with {C.TX}, {C.hints('tx', 'description', 'hint')} select txn_id, hint from hint_h")
add("t12_suggest_category", lambda k, f: X.with_suggested_category(
        T.read(k, f, "part").selectExpr("p_partkey", "p_name || ' ' || case p_size % 5 when 0 then 'FLORIST' when 1 then 'car wash' when 2 then 'Tap Room' else p_type end as name"), "name", "guess").select("p_partkey", "guess"),
    f"""with a as (select p_partkey, upper(p_name || ' ' || case p_size % 5 when 0 then 'FLORIST' when 1 then 'car wash' when 2 then 'Tap Room' else p_type end) as name from part),
 {C.cleaned('a', 'name', 'cn')} select p_partkey, {C.case_of('cn', V.ADVISORY_HINTS)} as guess from cn_z""")
_LOT = "upper('pos ' || p_name || ' lot ' || p_brand || ' no ' || cast(p_partkey as string))"
LCS = """short as (select g, arg_min(text, (length(text), text)) as seed from grp group by 1),
 pieces as (select g, seed, st, ln, substr(seed, st, ln) as piece from (select g, seed, unnest(range(1, length(seed) + 1)) as st from short), lateral (select unnest(range(4, length(seed) - st + 2)) as ln)),
 held as (select p.g, p.piece, p.st, p.ln from pieces p where not exists (select 1 from grp where grp.g = p.g and not contains(grp.text, p.piece))),
 lcs as (select short.g, coalesce(arg_max(piece, (ln, -st)), '') as common from short left join held using (g) group by 1)"""
add("t13_longest_common_substring", lambda k, f: G.longest_common_substring(
        T.read(k, f, "part").selectExpr("p_brand", f"{_LOT} as text"), "p_brand", "text"),
    f"with grp as (select distinct p_brand as g, {_LOT} as text from part), {LCS} select g as p_brand, common from lcs")
add("t13_longest_common_substring_merchants", lambda k, f: G.longest_common_substring(
        S.with_match_text(S.spend_rows(T.ledger(k, f)).where("category = 'uncategorized'")).select("merchant", F.upper("match_text").alias("text")), "merchant", "text"),
    on_ledger(f", grp as (select distinct merchant as g, upper(match_text) as text from spend where category = 'uncategorized'), {LCS} select g as merchant, common from lcs"))
add("t14_suggest_rule", lambda k, f: G.suggest_rules(T.ledger(k, f)),
    on_ledger(f""", txt as (select upper(match_text) as text, merchant, count(*) as n, sum(-signed) as spend, bool_and(category = 'uncategorized') as open from spend group by 1, 2),
 grp as (select text, merchant as g from txt where merchant in (select merchant from txt where open)), {LCS},
 cand as (select g as target, 1 as attempt, upper(g) as c from lcs union all select g, 2, trim(common) from lcs where trim(common) <> ''),
 proof as (select target, attempt, c, count(*) filter (where merchant = target) as covered, count(*) filter (where merchant <> target and not open) as stolen, sum(n) as matches, sum(spend) as total
  from cand join txt on contains(text, c) group by 1, 2, 3),
 good as (select proof.* from proof join (select g, count(*) as k from grp group by 1) z on z.g = target where covered = k and stolen = 0),
 best as (select target, min(attempt) as attempt from good group by 1),
 o as (select merchant, min({C.originator('match_text')}) as lo, max({C.originator('match_text')}) as hi, arg_min(substr(match_text, 1, 90), (date, txn_id)) as sample
  from spend where category = 'uncategorized' group by 1)
 select o.merchant, good.c as pattern_text, {n('matches')}, {d('total')}, sample, case when lo = hi then lo end as originator, good.target is not null as ok
 from o left join best on best.target = o.merchant left join good on good.target = best.target and good.attempt = best.attempt"""))
NEW_RULES = Rules(T.USER_RULES.payees, T.USER_RULES.ach, T.USER_RULES.merchants + [("cold (ring|bolt)", "Cold store", "Household")])
add("t15_recategorize", lambda k, f: K.recategorize(T.ledger(k, f), NEW_RULES).where("not (merchant <=> former_merchant) or not (category <=> former_category)")
    .select("txn_id", "former_merchant", "former_category", "merchant", "category"),
    on_ledger(""", moved as (select txn_id, merchant as former_merchant, category as former_category, 'Cold store' as merchant,
 case when kind = 'deposit' then 'Household' when kind = 'credit' then 'Refunds' else 'Household' end as category, match_text, kind from ledger
 where regexp_matches(match_text, '(?i)cold (ring|bolt)') and kind not in ('payment', 'fee', 'interest', 'cash_advance')
 and not (kind <> 'deposit' and regexp_matches(match_text, 'CO ID:(9000000007|9000000011)')))
 select txn_id, former_merchant, former_category, merchant, category from moved"""))


def recategorized_from_memory(k, f):
    """Outcomes under changed rules from a memory filled under the former ones; only texts they touch run again."""
    memory = ClassificationMemory(k, f"{checkpoint_root(k)}/memory-{uuid.uuid4().hex}")
    memory.update(T.ledger(k, f), T.USER_RULES)
    former = T.ledger(k, f).withColumnsRenamed({"merchant": "former_merchant", "category": "former_category"})
    return memory.classify(former, NEW_RULES)


add("t15_recategorize_memory", lambda k, f: recategorized_from_memory(k, f).where("not (merchant <=> former_merchant) or not (category <=> former_category)")
    .select("txn_id", "former_merchant", "former_category", "merchant", "category"), SQL["t15_recategorize"])
add("t15_applied", lambda k, f: K.applied(S.spend_rows(T.ledger(k, f)), "Groceries"),
    on_ledger("select count(*) filter (where category = 'Groceries') as applied from spend"))


# --- the whole way from text to checks ------------------------------------------------------------------
from ledgerloom.plans.catalog_ledger import ALL_CHECKS_SQL, MOVES, PAIRS, CONT  # noqa: E402
from ledgerloom.plans.proving import prove_lines  # noqa: E402

_proved: dict = {}


def proved(k, f):
    key = (k.sparkContext.applicationId, f)
    if key not in _proved:
        owners = T.statements(k, f).select("stmt_id", "owner")
        _proved[key] = prove_lines(RD.lines(k, f), D.detect(RD.lines(k, f)), RD.layout_lines(k, f),
                                   T.USER_RULES, T.KEY, owners)
    return _proved[key]


add("c9_statement_ok_from_text", lambda k, f: proved(k, f).checks.groupBy("stmt_id").agg(
        F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("check_count")),
    on_statements("select stmt_id, bool_and(ok) as ok, count(*) as check_count from every_check group by 1", ALL_CHECKS_SQL))
add("a19_run_totals_from_text", lambda k, f: proved(k, f).totals(),
    on_statements(f"""select *, failed_checks = 0 and unparsed = 0 and problems = 0 as can_generate from (select
 (select count(*) from stmts) as statements, (select count(*) from tx) as transactions, (select count(*) from every_check where not ok) as failed_checks,
 (select count(*) filter (where layout_name = '{RUN}' and txn_id % 35 = 4) + count(*) filter (where layout_name = '{RUN}' and txn_id % 97 = 0)
   + count(*) filter (where layout_name = '{SEC}' and txn_id % 36 = 2) from tx) as unparsed,
 (select count(*) from found) as problems)""", f"{ALL_CHECKS_SQL}, {PAIRS}, {MOVES}, {CONT}"))


# --- documents that cannot be placed in time ---------------------------------------------------------------
_LOST = "cast(split(stmt_id, '-')[0] as int) % 50 = 7"
PERIOD_LINES = {RUN: V.RUN_PERIOD, CARD: V.CARD_PERIOD, SEC: V.SEC_PERIOD, ANC: V.ANC_BALANCE}


def proved_with_losses(k, f):
    """The whole way over text in which every 50th statement lacks the line its period is read from."""
    printed = " or ".join(f"layout_name = '{n}' and text rlike {X.sql_literal(p)}" for n, p in PERIOD_LINES.items())
    lines = RD.lines(k, f).where(f"not ({_LOST} and ({printed}))")
    owners = T.statements(k, f).select("stmt_id", "owner")
    return prove_lines(lines, D.detect(RD.lines(k, f)), RD.layout_lines(k, f), T.USER_RULES, T.KEY, owners)


def documents_accounted(k, f):
    """Per detected document whether it became a statement or a problem."""
    found = proved_with_losses(k, f)
    read = found.statements.select("stmt_id", F.lit("statement").alias("became"))
    lost = found.problems.where("scope = 'document'").select("stmt_id", F.col("kind").alias("became"))
    return read.unionByName(lost)


add("s_documents_accounted", documents_accounted,
    on_statements(f"""select stmt_id, case when cast(string_split(stmt_id, '-')[1] as int) % 50 <> 7 then 'statement'
 when layout_name = '{ANC}' then 'no_balances' else 'no_period' end as became from stmts"""))
