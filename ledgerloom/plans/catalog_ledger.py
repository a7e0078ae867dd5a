"""Registered queries over the ledger view: projections, joins, reports, checks, time series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators import classify as K
from ledgerloom.operators import continuity as N
from ledgerloom.operators import insights as I
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import scoring as E
from ledgerloom.operators import spend as S
from ledgerloom.operators import suggest as G
from ledgerloom.operators import timeseries as W
from ledgerloom.plans import check_sql as C
from ledgerloom.plans import testview as T
from ledgerloom.plans.check_sql import d, n, on_all, on_ledger, on_statements, s
from ledgerloom.plans.registry import add
from ledgerloom.sources import rules as RU
from ledgerloom.sources import tables as TB
from ledgerloom.storage import checkpoint_root, spread

L, ST = T.ledger, T.statements
KEY = T.KEY
LAST = 24  # months of the period-scoped queries
MONTHS = "months as (select distinct month from spend)"
PICKED = f"{MONTHS}, picked as (select month from months order by month desc limit {LAST})"
PRIOR = f"""{PICKED}, numbered as (select month, row_number() over (order by month) as no from months),
 bounds as (select min(no) as lo, count(*) as len from numbered where month in (select month from picked)),
 prior as (select month from numbered, bounds where lo > len and no between lo - len and lo - 1)"""
RANK = "ranked as (select category, sum(-signed) as spend from spend group by 1)"


def picked(spark, sf):
    return S.period_months(S.spend_months(L(spark, sf)), LAST)


# --- projections and filters --------------------------------------------------------
add("p1_with_signed", lambda k, f: S.with_signed(L(k, f).drop("signed")).select("txn_id", "signed"),
    f"with {C.TX} select txn_id, {d('case when account = ' + C.lit('checking') + ' then amount else -amount end', 'signed')} from tx")
add("p2_with_match_text", lambda k, f: S.with_match_text(L(k, f)).select("txn_id", "match_text"),
    f"with {C.TX} select txn_id, case when descriptor <> '' then descriptor else description end as match_text from tx")
add("p3_with_balances", lambda k, f: S.with_balances(ST(k, f)).select("stmt_id", "opening_balance", "closing_balance"),
    on_statements(f"select stmt_id, {d('opening_balance')}, {d('closing_balance')} from bal"))
add("p4_account_label", lambda k, f: S.with_account_label(ST(k, f)).select("owner", "label").distinct(),
    on_statements("select distinct owner, account || ' ···' || account_last4 as label from stmts"))
add("p5_spend_rows", lambda k, f: S.spend_rows(L(k, f)).select("txn_id", "merchant", "category", "signed"),
    on_ledger(f"select txn_id, merchant, category, {d('signed')} from spend"))
add("p6_inflow_rows", lambda k, f: S.inflow_rows(L(k, f)).select("txn_id", "merchant", "category", "signed"),
    on_ledger(f"select txn_id, merchant, category, {d('signed')} from inflow"))
add("p7_period_filter", lambda k, f: S.period_filter(L(k, f), picked(k, f)).select("txn_id", "month"),
    on_ledger(f", {PICKED} select txn_id, month from ledger where month in (select month from picked)"))
add("p7_period_filter_year", lambda k, f: S.period_filter(L(k, f), S.period_months(S.spend_months(L(k, f)), "1997")).select("txn_id", "month"),
    on_ledger(f", {MONTHS} select txn_id, month from ledger where month in (select month from months) and month like '1997%'"))
add("p7_period_filter_custom",
    lambda k, f: S.period_filter(L(k, f), S.period_months(S.spend_months(L(k, f)), ("1996-03-15", "1997-02-01"))).select("txn_id", "month"),
    on_ledger(f", {MONTHS} select txn_id, month from ledger where month in (select month from months) and month between '1996-03' and '1997-02'"))
add("p8_prior_window", lambda k, f: S.prior_window(S.spend_months(L(k, f)), picked(k, f)),
    on_ledger(f", {PRIOR} select month from prior"))
add("p9_search", lambda k, f: S.search(L(k, f), "Anvil").select("txn_id", "date", "merchant", "matched"),
    on_ledger(f""", hit as (select * from ledger where contains(lower(merchant), 'anvil') or contains(lower(category), 'anvil')
 or contains(lower(description), 'anvil')) select txn_id, {s('date')}, merchant, (select count(*) from hit) as matched
 from hit order by date desc, txn_id desc limit 600"""))
add("p10_is_partial_month", lambda k, f: S.with_partial_flag(S.spend_months(L(k, f))),
    on_ledger(f", {MONTHS} select month, month in ((select min(month) from months), (select max(month) from months)) as partial from months"))

# --- joins ----------------------------------------------------------------------------
add("j1_originator_lookup", lambda k, f: K.with_originator_rule(
        L(k, f).withColumn("originator", X.ach_originator(F.col("description"))),
        "originator", T.read(k, f, "supplier").selectExpr(
            "s_suppkey as ord", "'9' || lpad(cast(s_suppkey as string), 9, '0') as pattern", "s_name as merchant", "'Housing' as category"), "hit")
    .select("txn_id", "originator", F.col("hit.merchant").alias("rule_merchant")),
    f"""with {C.TX}, o as (select txn_id, {C.originator('description')} as originator from tx)
 select txn_id, originator, s_name as rule_merchant from o left join supplier
 on upper(trim(originator)) = '9' || lpad(cast(s_suppkey as string), 9, '0')""")


def repeated_ids(k, f):
    """Two rules for each supplier's id, the later one under a padded id, and a third for every other supplier."""
    rules = T.read(k, f, "supplier").selectExpr("s_suppkey", "s_name", "'9' || lpad(cast(s_suppkey as string), 9, '0') as id")
    again = rules.selectExpr("s_suppkey + 1000000000 as ord", "' ' || id || ' ' as pattern", "'again ' || s_name as merchant")
    last = rules.where("s_suppkey % 2 = 0").selectExpr("s_suppkey + 2000000000", "id", "'last ' || s_name")
    return rules.selectExpr("s_suppkey as ord", "id as pattern", "s_name as merchant").union(again).union(last).withColumn(
        "category", F.lit("Housing"))


add("j1_repeated_originator_ids", lambda k, f: K.with_originator_rule(
        L(k, f).withColumn("originator", X.ach_originator(F.col("description"))), "originator", repeated_ids(k, f), "hit")
    .select("txn_id", F.col("hit.merchant").alias("rule_merchant")),
    f"""with {C.TX}, o as (select txn_id, {C.originator('description')} as originator from tx)
 select txn_id, case when s_suppkey % 2 = 0 then 'last ' else 'again ' end || s_name as rule_merchant from o left join supplier
 on upper(trim(originator)) = '9' || lpad(cast(s_suppkey as string), 9, '0')""")
add("j2_first_matching_rule", lambda k, f: K.with_rule_match(
        spread(S.with_match_text(L(k, f)).select(F.upper("match_text").alias("subject")).distinct(), "subject"), "subject", V.DESCRIPTOR_RULES, "hit")
    .select("subject", F.col("hit.merchant").alias("rule_merchant"), F.col("hit.category").alias("rule_category")),
    f"""with {C.TX}, t as (select distinct upper(coalesce(nullif(descriptor, ''), description)) as subject from tx),
 m as (select subject, {C.rule_number('subject', V.DESCRIPTOR_RULES)} as no from t)
 select subject, {C.pick(V.DESCRIPTOR_RULES, 1, 'no')} as rule_merchant, {C.pick(V.DESCRIPTOR_RULES, 2, 'no')} as rule_category from m""")


def rules_by_part(k, f):
    """Over 20,000 rules at any scale: a regex for every second pair of part and nation, then one for each part name."""
    pairs = T.read(k, f, "part").crossJoin(F.broadcast(T.read(k, f, "nation"))).where("(p_partkey + n_nationkey) % 2 = 0").selectExpr(
        "p_partkey * 25 + n_nationkey as ord", "'#' || p_partkey || ' +' || n_name || '\\\\b' as pattern", "p_name || ' ' || n_name as merchant",
        "p_brand as category")
    names = T.read(k, f, "part").groupBy("p_name").agg((F.lit(10 ** 9) + F.min("p_partkey")).alias("ord")).selectExpr(
        "ord", "p_name as pattern", "p_name as merchant", "'by name' as category")
    return pairs.unionByName(names)


add("j2_rules_as_table", lambda k, f: K.with_rule_table(
        S.with_match_text(L(k, f)).select(F.upper("match_text").alias("subject")).distinct(), "subject", rules_by_part(k, f), "hit")
    .select("subject", F.col("hit.merchant").alias("rule_merchant"), F.col("hit.category").alias("rule_category")),
    f"""with {C.TX}, t as (select distinct upper(coalesce(nullif(descriptor, ''), description)) as subject from tx),
 x as (select subject, unnest(regexp_extract_all(subject, '#([0-9]+) ', 1)) as pk from t),
 a as (select distinct subject, p_partkey * 25 + n_nationkey as ord, p_name || ' ' || n_name as m, p_brand as c from x
  join part on cast(p_partkey as string) = pk join nation on (p_partkey + n_nationkey) % 2 = 0 and regexp_matches(subject, '#' || pk || ' +' || upper(n_name) || '\b')),
 b as (select subject, 1000000000 + low as ord, p_name as m, 'by name' as c from t join (select p_name, min(p_partkey) as low from part group by 1) n on contains(subject, upper(p_name))),
 best as (select subject, arg_min(m, ord) as m, arg_min(c, ord) as c from (select * from a union all select * from b) group by 1)
 select t.subject, m as rule_merchant, c as rule_category from t left join best using (subject)""")
add("j2_rules_as_table_shipped", lambda k, f: K.with_rule_table(
        S.with_match_text(L(k, f)).select(F.upper("match_text").alias("subject")).distinct(), "subject",
        k.createDataFrame([(i, *r) for i, r in enumerate(V.DESCRIPTOR_RULES)], "ord bigint, pattern string, merchant string, category string"), "hit", "")
    .select("subject", F.col("hit.merchant").alias("rule_merchant"), F.col("hit.category").alias("rule_category")),
    f"""with {C.TX}, t as (select distinct upper(coalesce(nullif(descriptor, ''), description)) as subject from tx),
 m as (select subject, {C.rule_number('subject', V.DESCRIPTOR_RULES)} as no from t)
 select subject, {C.pick(V.DESCRIPTOR_RULES, 1, 'no')} as rule_merchant, {C.pick(V.DESCRIPTOR_RULES, 2, 'no')} as rule_category from m""")
add("j3_payee_prefix", lambda k, f: K.with_rail_outcome(L(k, f), "description", T.USER_RULES.payees, "hit")
    .where("hit is not null").select("txn_id", F.col("hit.merchant").alias("rule_merchant"), F.col("hit.category").alias("rule_category")),
    f"""with {C.TX} select txn_id,
 case when description like 'Zelle Payment From%' then 'Zelle received' when description like 'Zelle Payment To Alex%' then 'Rent (Alex)'
  when description like 'Zelle Payment To Robin%' then 'Cleaning (Robin)' when description like 'Zelle Payment To Casey%' then 'To Casey Jones'
  else 'Person-to-person payment' end as rule_merchant,
 case when description like 'Zelle Payment From%' then 'Income' when description like 'Zelle Payment To Alex%' then 'Housing'
  when description like 'Zelle Payment To Robin%' then 'Household' else 'People & Services' end as rule_category
 from tx where description like 'Zelle Payment%'""")
_TEXTS = """txt as (select upper(match_text) as text, merchant, count(*) as n, sum(-signed) as spend,
 bool_and(category = 'uncategorized') as open from spend group by 1, 2),
 targets as (select * from txt where merchant in (select merchant from txt where open))"""


def _rule_texts(k, f):
    return S.with_match_text(S.spend_rows(L(k, f))).groupBy(F.upper("match_text").alias("text"), "merchant").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("category") == V.UNCATEGORIZED).alias("open"))


def _proof(k, f):
    texts = _rule_texts(k, f)
    candidates = texts.where("open").select(F.col("merchant").alias("target"), F.upper("merchant").alias("candidate")).distinct()
    own = F.col("merchant") == F.col("target")
    return G.candidate_matches(candidates, texts).groupBy("target").agg(
        F.count_if(own).alias("covered"), F.count_if(~own & ~F.col("open")).alias("stolen"), F.sum("n").alias("row_count"))


add("j4_candidate_proof", _proof,
    on_ledger(f""", {_TEXTS}, cand as (select distinct merchant as target from txt where open)
 select target, {n("count(*) filter (where merchant = target)", 'covered')},
 {n("count(*) filter (where merchant <> target and not open)", 'stolen')}, {n('sum(n)', 'row_count')}
 from cand join txt on contains(text, upper(target)) group by target"""))
add("j5_previous_statement", lambda k, f: N.with_previous_statement(ST(k, f), KEY).select(
        "stmt_id", F.col("previous.stmt_id").alias("previous_id"), F.col("previous.period_end").alias("previous_end")),
    on_statements(f"""select stmt_id, lag(stmt_id) over w as previous_id, {s('lag(period_end) over w', 'previous_end')}
 from bal window w as (partition by account, owner order by period_start, stmt_id)"""))


def _hint_classifier(cases):
    hinted = X.with_category_hint(cases.withColumn("text", F.regexp_replace("text", r"\s+", " ")), "text", "hint")
    return hinted.select(
        "doc_id", F.col("lang").alias("merchant"), F.coalesce("hint", F.lit(V.UNCATEGORIZED)).alias("category"),
        "expected_merchant", "expected_category")


def _document_cases(k, f):
    docs = T.read(k, f, "documents").join(T.read(k, f, "labels"), "doc_id")
    return E.predictions(spread(docs, "doc_id").select(
        "doc_id", "text", "lang",
        F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("expected_merchant"),
        F.when(F.col("toxic") == 1, "Groceries").when(F.col("quality") == 1, V.UNCATEGORIZED)
        .otherwise("Dining & Delivery").alias("expected_category")), _hint_classifier)


DOC_CASES = f"""docs as (select doc_id, {C.sub('text', chr(92) + 's+', ' ')} as text, lang, quality, toxic from documents join labels using (doc_id)),
{C.hints('docs', 'text', 'hint')},
cases as (select doc_id, lang as merchant, coalesce(hint, 'uncategorized') as category,
 case when doc_id % 5 = 0 then 'en' else lang end as expected_merchant,
 case when toxic = 1 then 'Groceries' when quality = 1 then 'uncategorized' else 'Dining & Delivery' end as expected_category from hint_h)"""
add("j7_labels_join", _document_cases, f"with {DOC_CASES} select * from cases")
add("j8_rows_not_in_target", lambda k, f: S.rows_not_in(
        S.spend_rows(L(k, f)), S.spend_rows(L(k, f)).where("category = 'uncategorized'")).select("txn_id", "merchant"),
    on_ledger("select txn_id, merchant from spend where txn_id not in (select txn_id from spend where category = 'uncategorized')"))


def _change(k, f):
    months = S.spend_months(L(k, f))
    return S.period_change(L(k, f), picked(k, f), S.prior_window(months, picked(k, f)))


CHANGE = """cur as (select category, sum(-signed) as v from spend where month in (select month from picked) group by 1),
 pri as (select category, sum(-signed) as v from spend where month in (select month from prior) group by 1),
 change as (select coalesce(cur.category, pri.category) as category, coalesce(cur.v, 0) as current_spend,
 coalesce(pri.v, 0) as prior_spend, coalesce(cur.v, 0) - coalesce(pri.v, 0) as change from cur full join pri on cur.category = pri.category)"""
add("j9_period_change", _change,
    on_ledger(f", {PRIOR}, {CHANGE} select category, {d('current_spend')}, {d('prior_spend')}, {d('change')} from change"))
add("j10_aligned_months", lambda k, f: S.cashflow_monthly(L(k, f)).select("month", "money_in", "money_out"),
    on_ledger(f""", a as (select month, sum(-signed) as o from spend group by 1), b as (select month, sum(signed) as i from inflow group by 1)
 select coalesce(a.month, b.month) as month, {d('coalesce(i, 0)', 'money_in')}, {d('coalesce(o, 0)', 'money_out')} from a full join b on a.month = b.month"""))

# --- reports -----------------------------------------------------------------------------
A1 = on_ledger(f""", {RANK}, g as (select sum(-signed) as total, count(*) as c from spend)
 select category, {d('spend')}, cast(spend as double) / cast(total as double) as share, n as row_count
 from (select category, sum(-signed) as spend, count(*) as n from spend group by 1), g
 union all select 'TOTAL', {d('total', 'spend')}, 1.0, c from g""")
add("a1_spend_by_category", lambda k, f: S.spend_by_category(L(k, f)), A1)
add("a2_category_coverage", lambda k, f: S.category_coverage(L(k, f)),
    on_ledger(f"""select {d('sum(-signed)', 'total')}, {d("sum(-signed) filter (where category = 'uncategorized')", 'uncategorized')},
 count(*) as row_count, count(*) filter (where category = 'uncategorized') as open_rows,
 1 - cast(sum(-signed) filter (where category = 'uncategorized') as double) / cast(sum(-signed) as double) as share from spend"""))
add("a3_uncategorized_worklist", lambda k, f: S.uncategorized_worklist(L(k, f)),
    on_ledger(f"""select merchant, count(*) as row_count, {d('sum(-signed)', 'spend')} from spend where category = 'uncategorized'
 group by 1 order by sum(-signed) desc, merchant limit 40"""))
add("a4_uncategorized_enriched", lambda k, f: S.uncategorized_enriched(L(k, f)),
    on_ledger(f""", u as (select *, {C.originator('match_text')} as orig from spend where category = 'uncategorized'),
 g as (select merchant, count(*) as row_count, sum(-signed) as spend, arg_min(substr(match_text, 1, 90), (date, txn_id)) as sample,
  arg_min(orig, (date, txn_id)) filter (where orig is not null) as originator, upper(merchant) as m_up from u group by merchant),
 {C.cleaned('g', 'm_up', 'mc')}
 select merchant, row_count, {d('spend')}, sample, originator, {C.case_of('mc', V.ADVISORY_HINTS)} as guess,
 {d("(select sum(-signed) from u)", 'remaining')} from mc_z"""))
add("a5_monthly_category_grid", lambda k, f: S.monthly_category_grid(L(k, f)),
    on_ledger(f""", {RANK}, best as (select category from ranked order by spend desc, category limit 7),
 b as (select month, case when category in (select category from best) then category else 'Other' end as bucket, sum(-signed) as v from spend group by 1, 2),
 axes as (select m.month, x.bucket from (select distinct month from spend) m, (select category as bucket from best union all select 'Other') x)
 select axes.month, axes.bucket, {d('coalesce(v, 0)', 'spend')} from axes left join b on b.month = axes.month and b.bucket = axes.bucket"""))
add("a6_cashflow_monthly", lambda k, f: S.cashflow_monthly(L(k, f)),
    on_ledger(f", {C.FLOW} select month, {d('money_in')}, {d('income')}, {d('reimbursed')}, {d('one_off')}, {d('money_out')} from flow"))
add("a7_inflow_sources", lambda k, f: S.inflow_sources(L(k, f)),
    on_ledger(f"select merchant, category, {d('sum(signed)', 'total')}, count(*) as row_count from inflow group by 1, 2"))
add("a8_period_inflow_sources", lambda k, f: S.period_inflow_sources(L(k, f), picked(k, f)),
    on_ledger(f""", {PICKED}, g as (select merchant, arg_max(category, (date, txn_id)) as category, sum(signed) as total, count(*) as row_count
 from inflow where month in (select month from picked) group by 1)
 select merchant, category, {d('total')}, row_count,
 cast((select coalesce(sum(total) filter (where category = 'Income'), 0) from g) as double) / cast((select sum(total) from g) as double) as income_share from g"""))
add("a9_transfers_net", lambda k, f: S.transfers_net(L(k, f)),
    on_ledger(f"select {d('sum(signed)', 'transfers_net')} from ledger where category = 'Transfers'"))
FIN = f"""fin as (select m.month, coalesce(v, 0) as charges from (select distinct month from spend) m left join
 (select month, sum(amount) as v from ledger where account = 'credit' and kind in ('interest', 'fee') group by 1) x on x.month = m.month)"""
add("a10_finance_charges_monthly", lambda k, f: S.finance_charges_monthly(L(k, f)),
    on_ledger(f", {FIN} select month, {d('charges')}, month = (select month from fin order by charges desc, month limit 1) as peak from fin"))
add("a11_top_merchants", lambda k, f: S.top_merchants(L(k, f)),
    on_ledger(f"select merchant, {d('sum(-signed)', 'spend')}, count(*) as row_count from spend group by 1 order by sum(-signed) desc, merchant limit 15"))
add("a11_top_merchants_period", lambda k, f: S.top_merchants(S.period_filter(L(k, f), picked(k, f)), 12),
    on_ledger(f""", {PICKED} select merchant, {d('sum(-signed)', 'spend')}, count(*) as row_count from spend
 where month in (select month from picked) group by 1 order by sum(-signed) desc, merchant limit 12"""))
add("a12_coverage_stats", lambda k, f: S.coverage_stats(ST(k, f), L(k, f)),
    on_statements(f"""select {s('min(period_start)', 'start')}, {s('max(period_end)', '"end"')}, count(*) as statements,
 (select count(*) from tx) as row_count from stmts"""))
EDGES = """pts as (select owner, account, stmt_id, period_end as date, closing_balance as v, strftime(period_end, '%Y-%m') as month
 from bal where closing_balance is not null)"""
add("a13_headline_kpis", lambda k, f: S.headline_kpis(L(k, f), ST(k, f), LAST, KEY),
    on_all(f"""select count(*) as months, count(*) filter (where not partial) as full_months, {d('sum(money_in)', 'money_in')},
 {d('sum(money_out)', 'spending')}, {d('sum(money_in) - sum(money_out)', 'net')}, {d('sum(income)', 'income')},
 cast(sum(income) filter (where not partial) as double) / count(*) filter (where not partial) as avg_income,
 cast(sum(money_out) filter (where not partial) as double) / count(*) filter (where not partial) as avg_spend,
 (select {d('sum(b)', 'b')} from (select arg_max(v, (date, stmt_id)) as b from pts where account = 'credit' and month in (select month from picked) group by owner)) as card_now,
 (select {d('sum(b)', 'b')} from (select arg_min(v, (date, stmt_id)) as b from pts where account = 'credit' and month in (select month from picked) group by owner)) as card_then,
 (select {d('sum(charges)', 'c')} from fin where month in (select month from picked)) as finance_charges,
 (select category from tops order by v desc, category limit 1) as top_category,
 (select {d('max(v)', 'v')} from tops) as top_spend, (select {d('max(v)', 'v')} from tops) / cast(sum(money_out) as double) as top_share
 from (select flow.*, month in ((select min(month) from months), (select max(month) from months)) as partial from flow where month in (select month from picked))""",
    f"{PICKED}, {C.FLOW}, {FIN}, {EDGES}, tops as (select category, sum(-signed) as v from spend where month in (select month from picked) group by 1)"))
add("a14_category_totals_full", lambda k, f: S.category_totals_full(S.period_filter(L(k, f), picked(k, f))),
    on_ledger(f""", {PICKED}, p as (select category, sum(-signed) as v from spend where month in (select month from picked) group by 1)
 select category, {d('v', 'spend')}, cast(v as double) / cast((select sum(v) from p) as double) as share from p where v > 0"""))
add("a15_balances_timeline", lambda k, f: S.balances_timeline(ST(k, f), KEY),
    on_statements(f"select account, owner, stmt_id, {s('period_end', 'date')}, {d('closing_balance', 'balance')}, account <> 'credit' as asset from bal where closing_balance is not null"))
add("a16_books_close", lambda k, f: S.books_close(L(k, f)),
    on_ledger(f""", g as (select (select sum(signed) from inflow) as i, (select sum(-signed) from spend) as o,
 (select sum(signed) from ledger where category = 'Transfers') as t, (select sum(signed) from ledger) as a)
 select {d('i', 'money_in')}, {d('o', 'money_out')}, {d('t', 'transfers')}, {d('a', 'actual')}, {d('i - o + t', 'expected')}, abs(i - o + t - a) <= 0.005 as ok from g"""))
add("a17_deficit_months", lambda k, f: S.deficit_months(S.cashflow_monthly(L(k, f))),
    on_ledger(f""", {C.FLOW} select count(*) as months, count(*) filter (where money_in < money_out) as deficit_months,
 {d('sum(money_in)', 'money_in')}, {d('sum(money_out)', 'money_out')}, {d('sum(money_in) - sum(money_out)', 'net')} from flow"""))
add("a18_account_groups", lambda k, f: S.account_groups(ST(k, f), KEY),
    on_statements("select account, owner, count(*) as statements from stmts group by 1, 2"))
add("a21_eval_score", lambda k, f: E.eval_score(_document_cases(k, f), 0.5, 0.5),
    f"""with {DOC_CASES}, g as (select count(*) as total, count(*) filter (where merchant = expected_merchant) as merchant_matches,
 count(*) filter (where category = expected_category) as category_matches,
 count(*) filter (where merchant = expected_merchant and category = expected_category) as exact_matches,
 count(*) filter (where expected_category <> 'uncategorized') as coverable,
 count(*) filter (where expected_category <> 'uncategorized' and category <> 'uncategorized') as covered from cases)
 select *, coalesce(exact_matches / nullif(total, 0), 1.0) as accuracy, coalesce(covered / nullif(coverable, 0), 1.0) as coverage,
 coalesce(exact_matches / nullif(total, 0), 1.0) >= 0.5 as accuracy_ok, coalesce(covered / nullif(coverable, 0), 1.0) >= 0.5 as coverage_ok from g""")
add("a22_eval_misses", lambda k, f: E.eval_misses(_document_cases(k, f)),
    f"with {DOC_CASES} select * from cases where merchant <> expected_merchant or category <> expected_category")



def _normalize_cases(k, f):
    """Every transaction as a case: the published outcome is expected, but for every tenth and every seventh row."""
    expected = L(k, f).select("txn_id", F.when(F.col("txn_id") % 10 == 0, "Nobody").otherwise(F.col("merchant")).alias("expected_merchant"),
                              F.when(F.col("txn_id") % 7 == 0, "uncategorized").otherwise(F.col("category")).alias("expected_category"))
    cases = T.transactions(k, f).join(expected, "txn_id")
    return E.predictions(cases, lambda rows: K.with_classification(rows, T.USER_RULES))


_NORMALIZE = """, cases as (select txn_id, merchant, category, case when txn_id % 10 = 0 then 'Nobody' else merchant end as expected_merchant,
 case when txn_id % 7 = 0 then 'uncategorized' else category end as expected_category from ledger)"""
add("a21_eval_score_normalize", lambda k, f: E.eval_score(_normalize_cases(k, f)),
    on_ledger(f"""{_NORMALIZE}, g as (select count(*) as total, count(*) filter (where merchant = expected_merchant) as merchant_matches,
 count(*) filter (where category = expected_category) as category_matches,
 count(*) filter (where merchant = expected_merchant and category = expected_category) as exact_matches,
 count(*) filter (where expected_category <> 'uncategorized') as coverable,
 count(*) filter (where expected_category <> 'uncategorized' and category <> 'uncategorized') as covered from cases)
 select *, exact_matches / total as accuracy, covered / coverable as coverage from g"""))
add("a22_eval_misses_normalize", lambda k, f: E.eval_misses(_normalize_cases(k, f)).select(
        "txn_id", "merchant", "category", "expected_merchant", "expected_category"),
    on_ledger(f"{_NORMALIZE} select * from cases where merchant <> expected_merchant or category <> expected_category"))

# --- reconciliation --------------------------------------------------------------------------
CHECK_COLUMNS = ["stmt_id", "name", "expected", "actual", "delta", "ok"]


def check_sql(rows: list[tuple[str, str, str, str]], tolerance: str = "0.005") -> str:
    parts = [f"select stmt_id, {C.lit(name)} as name, {e} as e, {a} as a from fig_all where {where} and ({e}) is not null and ({a}) is not null"
             for name, e, a, where in rows]
    return (f"select stmt_id, name, {d('e', 'expected')}, {d('a', 'actual')}, {d('a - e', 'delta')}, abs(a - e) <= {tolerance} as ok "
            f"from ({' union all '.join(parts)})")


FIG_ALL = """fig_all as (select * from stmts)"""
ENDING = [("ending_balance", "ending_balance", "beginning_balance + net", "true")]
DEPOSITS = [("deposits_total", "deposits", "positive", f"{C.T.RUN} or {C.T.ANC}"), ("deposits_total", "total_deposits", "positive", C.T.SEC)]
DEPOSITS[0] = ("deposits_total", "deposits", "positive", f"({C.T.RUN} or {C.T.ANC})")
WITHDRAWALS = [("withdrawals_total", "electronic_withdrawals", "negative", C.T.RUN),
               ("subtractions_total", "total_other_subtractions", "negative", C.T.SEC)]
BUCKETS = [("purchases_total", "purchases", "purchases_sum", "true"), ("payments_total", "payments_credits", "payments + credits", "true"),
           ("cash_advances_total", "cash_advances", "advances", "true"), ("fees_total", "fees_charged", "fees_sum", "true"),
           ("interest_total", "interest_charged", "interest_sum", "true")]
NEWBAL = [("new_balance", "new_balance", "previous_balance + net", "true")]
PAGES = [("fees_page_agrees", "fees_charged", "total_fees_line", "true"), ("interest_page_agrees", "interest_charged", "total_interest_line", "true"),
         ("summary_agrees_deposits", "deposits", "total_deposits", "true"),
         ("summary_agrees_other_subtractions", "other_subtractions", "total_other_subtractions", "true")]
PAPER = [("checks_total", "checks", "-paper_checks", C.T.ANC), ("other_withdrawals_total", "other_withdrawals", "-(negative - paper_checks)", C.T.ANC),
         ("withdrawals_total", "withdrawals", "-negative", C.T.ANC)]
EVERY = ENDING + DEPOSITS + WITHDRAWALS + BUCKETS + NEWBAL + PAGES + PAPER


def _check(fn):
    return lambda k, f: fn(ST(k, f), L(k, f)).select(*CHECK_COLUMNS)


BREAKS = """walk as (select tx.*, opening + sum(amount) over (partition by stmt_id order by date, txn_id) as running from tx join stmts using (stmt_id)
  where tx.layout_name = 'chase_checking'),
 printed as (select *, running + case when txn_id % 101 = 0 then 0.25 else 0.00 end as balance from walk),
 stepped as (select *, abs(coalesce(lag(balance) over (partition by stmt_id order by date, txn_id), running - amount) + amount - balance) > 0.005 as broken from printed),
 breaks as (select s.stmt_id, count(*) filter (where broken) as b from stmts s left join stepped using (stmt_id) where s.layout_name = 'chase_checking' group by 1)"""


def _breaks(k, f):
    return R.running_balance_breaks(ST(k, f), T.running_rows(k, f), segments=["date"], order=["txn_id"])


add("c1_running_balance_breaks", lambda k, f: _breaks(k, f).select("stmt_id", "actual", "ok"),
    on_statements(f"select stmt_id, {d('b', 'actual')}, b = 0 as ok from breaks", BREAKS))
add("c2_ending_balance", _check(R.ending_balance), on_statements(check_sql(ENDING), FIG_ALL))
add("c3_deposits_total", _check(R.deposits_total), on_statements(check_sql(DEPOSITS), FIG_ALL))
add("c4_withdrawals_total", _check(R.withdrawals_total), on_statements(check_sql(WITHDRAWALS), FIG_ALL))
add("c5_bucket_total", _check(R.bucket_totals), on_statements(check_sql(BUCKETS), FIG_ALL))
add("c6_new_balance", _check(R.new_balance), on_statements(check_sql(NEWBAL), FIG_ALL))
add("c7_page_agrees", _check(R.page_agreement), on_statements(check_sql(PAGES), FIG_ALL))
add("c8_paper_check_totals", _check(R.paper_check_totals), on_statements(check_sql(PAPER), FIG_ALL))
CHECKS_SQL = f"{FIG_ALL}, checks_all as ({check_sql(EVERY)})"


def all_checks(k, f):
    return R.total_checks(ST(k, f), L(k, f)).unionByName(_breaks(k, f))


ALL_CHECKS_SQL = f"{CHECKS_SQL}, {BREAKS}, every_check as (select stmt_id, name, delta, ok from checks_all union all " \
                 "select stmt_id, 'running_balance_breaks', cast(b as double), b = 0 from breaks)"
add("c9_statement_ok", lambda k, f: R.statement_ok(ST(k, f), all_checks(k, f)),
    on_statements("""select s.stmt_id, coalesce(bool_and(ok), true) as ok, count(ok) as check_count from stmts s left join every_check e
 on e.stmt_id = s.stmt_id group by 1""", ALL_CHECKS_SQL))
PAIRS = """pairs as (select *, lag(period_end) over w as prior_end, lag(closing_balance) over w as prior_close,
 lag(stmt_id) over w is not null as has_prior from bal window w as (partition by account, owner order by period_start, stmt_id))"""
GAP = "date_diff('day', prior_end, period_start) - 1"
add("c10_period_gaps", lambda k, f: N.period_gaps(ST(k, f), KEY),
    on_statements(f"select account, owner, stmt_id, {s('prior_end')}, {s('period_start')}, cast({GAP} as int) as days from pairs where {GAP} <> 0", PAIRS))
add("c11_balance_chain", lambda k, f: N.balance_chain(ST(k, f), KEY),
    on_statements(f"""select account, owner, stmt_id, {d('prior_close')}, {d('opening_balance')} from pairs
 where abs(prior_close - opening_balance) > 0.005""", PAIRS))
MOVES = """moves as (select account, owner, (case when account = 'checking' then 1 else -1 end) *
 (arg_max(closing_balance, (period_start, stmt_id)) - arg_min(opening_balance, (period_start, stmt_id))) as m from bal group by 1, 2)"""
add("c12_net_position", lambda k, f: N.net_position(ST(k, f), L(k, f), KEY),
    on_statements(f"""select {d('sum(m)', 'expected')}, bool_and(m is not null) as complete, {d('(select sum(signed) from tx)', 'actual')},
 abs(sum(m) - (select sum(signed) from tx)) <= 0.01 as ok from moves""", MOVES))
CENTS = "cast(cast({} as decimal(28,2)) as varchar)"
CONT = f"""found as (select 'account' as scope, account, account_last4, stmt_id, 'period_gap' as kind, cast({GAP} as decimal(28,2)) as measured, 0 as expected,
  account || ' ···' || account_last4 || ' has ' || case when {GAP} > 0 then '+' else '' end || ({GAP}) || ' days between the period ending '
   || cast(prior_end as date) || ' and the one starting ' || cast(period_start as date) as detail
  from pairs where {GAP} <> 0
 union all select 'account', account, account_last4, stmt_id, 'balance_chain', opening_balance, prior_close,
  account || ' ···' || account_last4 || ' opens at ' || {CENTS.format('opening_balance')} || ' after closing at ' || {CENTS.format('prior_close')}
  from pairs where abs(prior_close - opening_balance) > 0.005
 union all select 'corpus', null, null, null, 'net_position', a, m, 'all rows sum to ' || {CENTS.format('a')} || ', all balances to ' || {CENTS.format('m')} from (select (select sum(signed) from tx) as a, sum(m) as m from moves) where abs(a - m) > 0.01)"""
add("c13_continuity", lambda k, f: N.continuity(ST(k, f), L(k, f), KEY),
    on_statements(f"select scope, account, account_last4, stmt_id, kind, detail, {d('measured')}, {d('expected')} from found", f"{PAIRS}, {MOVES}, {CONT}"))


def no_unparsed(k, f):
    """Ledger rows whose source could not name a part stand in for lines left unparsed."""
    return L(k, f).where("description like 'OPAQUE%'").select(
        "stmt_id", F.col("source_line").alias("line_no"), F.col("description").alias("text"))


A19 = on_statements("""select *, failed_checks = 0 and unparsed = 0 and problems = 0 as can_generate from (select
 (select count(*) from stmts) as statements, (select count(*) from tx) as transactions, (select count(*) from every_check where not ok) as failed_checks,
 (select count(*) from tx where description like 'OPAQUE%') as unparsed, (select count(*) from found) as problems)""",
    f"{ALL_CHECKS_SQL}, {PAIRS}, {MOVES}, {CONT}")
add("a19_run_totals", lambda k, f: N.run_totals(ST(k, f), L(k, f), all_checks(k, f), no_unparsed(k, f), N.continuity(ST(k, f), L(k, f), KEY)), A19)
add("a20_statement_report", lambda k, f: N.statement_report(ST(k, f), L(k, f), all_checks(k, f), no_unparsed(k, f)),
    on_statements(f"""select s.stmt_id, account, account_last4, {s('period_start')}, {s('period_end')}, coalesce(r.c, 0) as row_count,
 coalesce(v.checks, 0) as check_count, coalesce(v.fails, 0) as failed_count, coalesce(v.failed, '') as failed,
 coalesce(u.c, 0) as unparsed_count, coalesce(u.t, '') as unparsed_sample
 from stmts s left join (select stmt_id, count(*) as c from tx group by 1) r using (stmt_id)
 left join (select stmt_id, count(*) as checks, count(*) filter (where not ok) as fails,
  string_agg(name || ':' || cast(cast(delta as decimal(18,2)) as string), ', ' order by name || ':' || cast(cast(delta as decimal(18,2)) as string)) filter (where not ok) as failed
  from every_check group by 1) v using (stmt_id)
 left join (select stmt_id, count(*) as c, array_to_string((list(description order by source_line))[1:5], ' | ') as t from tx where description like 'OPAQUE%' group by 1) u using (stmt_id)""",
    ALL_CHECKS_SQL))

# --- time series ---------------------------------------------------------------------------
RR = T.recurring_rows
REC = """rr as (select 'SUP ' || cast(l_suppkey as string) as merchant, min(cast(l_shipdate as date)) as date,
  -sum(cast(l_extendedprice as decimal(18,2))) as signed, 'Utilities' as category, 0 as txn_id
  from lineitem group by l_suppkey, strftime(l_shipdate, '%Y-%m')
  having not (l_suppkey % 10 = 3 and min(cast(l_shipdate as date)) > date '1999-06-30')
 union all select 'CUS ' || cast(o_custkey as string), cast(o_orderdate as date), -cast(o_totalprice as decimal(18,2)), 'Shopping', o_orderkey from orders),
 gaps as (select merchant, date, date_diff('day', lag(date) over (partition by merchant order by date), date) as gap
  from (select distinct merchant, date from rr) qualify gap is not null),
 gm as (select merchant, count(*) as gap_count, median(gap) as gap_median from gaps group by 1),
 gs as (select gm.*, mad as gap_mad from gm join (select merchant, median(abs(gap - gap_median)) as mad from gaps join gm using (merchant) group by 1) using (merchant))"""
CADENCE = ("case when gap_median between 5 and 9 then 'weekly' when gap_median between 12 and 18 then 'biweekly' when gap_median between 25 and 36 then 'monthly' "
           "when gap_median between 84 and 98 then 'quarterly' when gap_median between 350 and 380 then 'annual' end")
FOUND = f"""{REC}, am as (select merchant, count(*) as row_count, count(distinct strftime(date, '%Y-%m')) as months, sum(-signed) as total,
  stddev_pop(cast(-signed as double)) / (cast(sum(-signed) as double) / count(*)) as cv, median(cast(-signed as double)) as med,
  min(date) as first_date, max(date) as last_date, arg_min(-signed, (date, txn_id)) as first_amount, arg_max(-signed, (date, txn_id)) as last_amount,
  arg_max(category, (date, txn_id)) as category from rr group by 1),
 rec0 as (select *, {CADENCE} as cadence, date_diff('day', last_date, date '2001-08-01') as stale from am join gs using (merchant)
  where row_count >= 4 and months >= 4 and gap_count >= 3 and gap_mad / gap_median <= 0.20 and total > 0 and cv <= 0.60),
 rec as (select merchant, category, cadence, floor(med * 100 + 0.5) / 100 as typical, row_count, total,
  floor(med * (case cadence when 'weekly' then {52 / 12!r} when 'biweekly' then {26 / 12!r} when 'monthly' then 1.0 when 'quarterly' then {1 / 3!r} else {1 / 12!r} end) * 100 + 0.5) / 100 as monthly,
  first_date, last_date, first_amount, last_amount, cv > 0.15 as variable, stale <= gap_median * 2.5 as active,
  case when stale <= gap_median * 2.5 then 0 else cast(floor(stale / gap_median) as int) end as missed from rec0 where cadence is not null)"""


def recurring(k, f):
    return W.find_recurring(RR(k, f), "2001-08-01")


add("w1_gaps", lambda k, f: W.gaps(W.charge_days(RR(k, f))), f"with {REC} select merchant, {s('date')}, cast(gap as int) as gap from gaps")
add("w2_median_mad", lambda k, f: W.gap_statistics(W.gaps(W.charge_days(RR(k, f)))),
    f"with {REC} select merchant, gap_count, {d('gap_median')}, {d('gap_mad')} from gs")
add("w3_cadence", lambda k, f: W.gap_statistics(W.gaps(W.charge_days(RR(k, f)))).select("merchant", W.cadence(F.col("gap_median")).alias("cadence")),
    f"with {REC} select merchant, {CADENCE} as cadence from gs")
add("w4_find_recurring", recurring,
    f"""with {FOUND} select merchant, category, cadence, {d('typical')}, row_count, {d('total')}, {d('monthly')}, {s('first_date')}, {s('last_date')},
 {d('first_amount')}, {d('last_amount')}, variable, active, missed from rec""")
add("w5_price_drift", lambda k, f: W.price_drift(recurring(k, f)),
    f"""with {FOUND} select merchant, {d('first_amount')}, {d('last_amount')},
 (cast(last_amount as double) - cast(first_amount as double)) / cast(first_amount as double) * 100 as pct from rec
 where active and first_amount > 0 and (cast(last_amount as double) - cast(first_amount as double)) / cast(first_amount as double) * 100 >= 8""")
add("w6_monthly_obligations", lambda k, f: W.monthly_obligations(recurring(k, f)).select(
        "merchant", "category", "cadence", "monthly", W.cents(F.col("total_monthly")).alias("total_monthly"), W.cents(F.col("total_yearly")).alias("total_yearly")),
    f"""with {FOUND}, t as (select sum(cast(monthly as decimal(18,2))) as m from rec where active)
 select merchant, category, cadence, {d('monthly')}, {d('(select m from t)', 'total_monthly')}, {d('(select m * 12 from t)', 'total_yearly')} from rec where active""")
add("w7_recurring_status", lambda k, f: W.recurring_status(recurring(k, f)).withColumn("monthly", W.cents(F.col("monthly"))),
    f"""with {FOUND} select count(*) filter (where active) as live, count(*) filter (where not active) as ended,
 {d('coalesce(sum(cast(monthly as decimal(18,2))) filter (where active), 0)', 'monthly')} from rec""")
STREAK = f"""isl as (select month, row_number() over (order by month) - row_number() over (partition by money_in < money_out order by month) as i, money_in < money_out as red from flow_p),
 runs as (select i, count(*) as len from isl where red group by 1)"""
add("w8_longest_streak", lambda k, f: W.longest_streak(S.cashflow_monthly(L(k, f))),
    on_ledger(f", {C.FLOW}, flow_p as (select * from flow), {STREAK} select coalesce(max(len), 0) as streak from runs"))
add("w9_running_balance", lambda k, f: T.running_rows(k, f).select("txn_id", "running"),
    on_statements(f"select txn_id, {d('running')} from walk", BREAKS))
add("w10_balance_edges", lambda k, f: S.balance_edges(ST(k, f), KEY),
    on_statements(f"""select account, owner, {d('arg_min(v, (date, stmt_id))', 'first_balance')}, {d('arg_max(v, (date, stmt_id))', 'last_balance')},
 {s('min(date)', 'first_date')}, {s('max(date)', 'last_date')} from pts group by 1, 2""", EDGES))
add("w11_insights", lambda k, f: I.insights(L(k, f), recurring(k, f), LAST),
    f"""with {C.LEDGER}, {C.SPENDS}, {FOUND}, {PRIOR}, {CHANGE}, {C.FLOW}, flow_p as (select * from flow where month in (select month from picked)), {STREAK},
 t as (select cast(sum(current_spend) as double) as c, cast(sum(prior_spend) as double) as p from change),
 sums as (select cast(sum(-signed) filter (where category = 'uncategorized') as double) as u, cast(sum(-signed) as double) as a from spend where month in (select month from picked)),
 f as (select 'total_change' as finding, case when c > p then 'up' else 'down' end as tone, abs(c - p) as weight, cast(null as string) as subject, c as value, p as reference, (c - p) / p * 100 as pct
  from t where p > 0 and abs((c - p) / p * 100) >= 3
 union all (select 'category_change', case when change > 0 then 'up' else 'down' end, abs(cast(change as double)), category, cast(current_spend as double), cast(prior_spend as double),
  abs(cast(current_spend as double) - cast(prior_spend as double)) / cast(prior_spend as double) * 100 from change where prior_spend >= 20 and abs(change) >= 20 order by abs(change) desc, category limit 1)
 union all (select 'largest_row', 'neutral', cast(-signed as double) * 0.5, merchant, cast(-signed as double), null, null from spend where month in (select month from picked) order by signed, date desc, txn_id desc limit 1)
 union all select 'price_drift', 'up', (cast(last_amount as double) - cast(first_amount as double)) * 12, merchant, cast(last_amount as double), cast(first_amount as double),
  (cast(last_amount as double) - cast(first_amount as double)) / cast(first_amount as double) * 100 from rec where active and first_amount > 0
  and (cast(last_amount as double) - cast(first_amount as double)) / cast(first_amount as double) * 100 >= 8
 union all select 'uncategorized', 'warn', u, null, u, a, u / a * 100 from sums where u >= 20 and u / a >= 0.01
 union all select 'deficit_streak', 'warn', max(len) * 100.0, null, max(len), null, null from runs having max(len) >= 2)
 select finding, tone, {d('weight')}, subject, {d('value')}, {d('reference')}, {d('pct')} from f order by weight desc, finding, subject limit 6""")
add("w12_sequence_statements", lambda k, f: W.sequence_statements(ST(k, f), KEY).select("stmt_id", "position"),
    on_statements("select stmt_id, row_number() over (partition by account, owner order by period_start, stmt_id) as position from stmts"))

# --- sort, top-k, set operations --------------------------------------------------------------
add("o1_ledger_order", lambda k, f: S.ledger_order(L(k, f)).select("date", "account", "source_file", "source_line"),
    f"with {C.TX} select {s('date')}, account, source_file, source_line from tx order by date, account, source_file, source_line")
add("o2_report_order", lambda k, f: S.report_order(ST(k, f)).select("account", "period_start", "stmt_id"),
    on_statements(f"select account, {s('period_start')}, stmt_id from stmts order by account, period_start, stmt_id"))
add("o3_top_categories", lambda k, f: S.ranked_categories(L(k, f)).limit(7),
    on_ledger(f", {RANK} select category, {d('spend')} from ranked order by spend desc, category limit 7"))
add("o4_recurring_order", lambda k, f: W.recurring_order(recurring(k, f)).select("merchant", "active", "monthly"),
    f"with {FOUND} select merchant, active, {d('monthly')} from rec order by active desc, monthly desc, merchant")
add("u1_summary_keys", lambda k, f: TB.summary_keys(ST(k, f)),
    on_statements("select distinct key from (unpivot (select " + ", ".join(T.SUMMARY_COLUMNS) + " from stmts) on *  into name key value v)"))
add("u2_month_union", lambda k, f: S.active_months(L(k, f)),
    on_ledger("select month from spend union select month from inflow"))
add("u3_zero_filled_grid", lambda k, f: S.category_month_matrix(L(k, f)),
    on_ledger(f"""select m.month, c.category, {d('coalesce(v, 0)', 'spend')} from (select distinct month from spend) m cross join (select distinct category from spend) c
 left join (select month, category, sum(-signed) as v from spend group by 1, 2) x on x.month = m.month and x.category = c.category"""))


def part_rules(k, f):
    """Hand-written rules stand-in: a merchant rule per part name."""
    return T.read(k, f, "part").groupBy(F.upper("p_name").alias("pattern")).agg(F.min("p_partkey").cast("int").alias("ord")).select(
        "ord", F.lit("merchant").alias("stage"), "pattern", F.initcap("pattern").alias("merchant"), F.lit("Shopping").alias("category"))


PART_RULES = """pr as (select cast(min(p_partkey) as int) as ord, 'merchant' as stage, upper(p_name) as pattern,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as merchant, 'Shopping' as category from part group by p_name)"""
add("u4_prepend_user_rules", lambda k, f: RU.prepend_rules(part_rules(k, f).where("pattern like 'RED%'"), part_rules(k, f)),
    f"with {PART_RULES} select * from pr union all select ord - 1000000, stage, pattern, merchant, category from pr where pattern like 'RED%'")
add("k5_upsert_rule", lambda k, f: RU.upsert_rule(part_rules(k, f), "merchant", "BLUE RING", "Ring shop", "Household"),
    f"""with {PART_RULES} select * from pr where pattern <> 'BLUE RING'
 union all select cast((select max(ord) + 1 from pr) as int), 'merchant', 'BLUE RING', 'Ring shop', 'Household'""")
add("k5_remove_rule", lambda k, f: RU.remove_rule(part_rules(k, f), "merchant", "RED BOLT"),
    f"with {PART_RULES} select * from pr where pattern <> 'RED BOLT'")

# --- sinks: what they would write ------------------------------------------------------------
FIELDS = [c for c in V.TRANSACTION_FIELDS if c != "balance"]
add("k1_write_transactions", lambda k, f: TB.export_transactions(L(k, f)).drop("balance"),
    on_ledger("select " + ", ".join(s(c) if c in ("date", "statement_close", "period_start", "period_end") else d(c) if c in ("amount", "signed") else c for c in FIELDS) + " from ledger"))
KEYS = sorted(T.SUMMARY_COLUMNS)
add("k2_write_statements", lambda k, f: TB.export_statements(ST(k, f), all_checks(k, f)),
    on_statements(f"""select account, account_last4, source_file as file, {s('period_start')}, {s('period_end')}, txn_count,
 coalesce(b, true) as checks_passed, {', '.join(d(c) for c in KEYS)} from stmts left join (select stmt_id, bool_and(ok) as b from every_check group by 1) using (stmt_id)""", ALL_CHECKS_SQL))
add("k2_write_statements_long", lambda k, f: TB.export_statement_values(ST(k, f)),
    on_statements(f"""select account, account_last4, file, {s('period_start')}, key, {d('v', 'value')} from (unpivot (select account, account_last4,
 source_file as file, period_start, {', '.join(KEYS)} from stmts) on {', '.join(KEYS)} into name key value v)"""))
BY_CATEGORY = on_ledger(f""", g as (select m.month, c.category, coalesce(v, 0) as v from (select distinct month from spend) m cross join (select distinct category from spend) c
 left join (select month, category, sum(-signed) as v from spend group by 1, 2) x on x.month = m.month and x.category = c.category)
 select month, category, {d('v', 'spend')} from g union all select month, 'total', {d('sum(v)', 'spend')} from g group by 1""")
add("k3_write_by_category", lambda k, f: TB.export_by_category_long(L(k, f)), BY_CATEGORY)
# the matrix has a column for each category there is, so its cells are compared
add("k3_write_by_category_wide", lambda k, f: TB.export_by_category(L(k, f)).unpivot("month", None, "category", "spend"), BY_CATEGORY)


def written_and_read_back(k, f):
    """What readers of the published table see after a refused and a forced write of an unclean ledger."""
    root = f"{checkpoint_root(k)}/gated-{uuid.uuid4().hex}"
    totals = N.run_totals(ST(k, f), L(k, f), all_checks(k, f), no_unparsed(k, f), N.continuity(ST(k, f), L(k, f), KEY))
    tables = {"transactions": TB.export_transactions(L(k, f))}
    if not TB.gated_write(tables, totals, root, fmt="parquet"):
        TB.gated_write({"transactions": tables["transactions"].where(F.lit(False))}, totals, root, force=True, fmt="parquet")
        TB.gated_write(tables, totals, root, force=True, fmt="parquet")
    return k.read.parquet(f"{TB.current_version(k, root)}/transactions")


add("k4_gated_write", lambda k, f: written_and_read_back(k, f).select(
        "account", "date", "merchant", "category", "description", "amount", "signed", "kind", "source_line"),
    on_ledger(f"select account, {s('date')}, merchant, category, description, {d('amount')}, {d('signed')}, kind, source_line from ledger"))
add("k4_gate", lambda k, f: TB.gate(N.run_totals(ST(k, f), L(k, f), all_checks(k, f), no_unparsed(k, f), N.continuity(ST(k, f), L(k, f), KEY))),
    A19.replace("select *, failed_checks = 0", "select failed_checks, unparsed, problems, failed_checks = 0").replace("as can_generate", "as may_write"))
